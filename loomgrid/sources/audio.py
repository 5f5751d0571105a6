"""Cutting windows out of audio files, where the machine has the program for it."""

from __future__ import annotations

import os
import shutil
import subprocess
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def program(given: str | None = None) -> str:
    """The path of ffmpeg; an error if there is none."""
    found = shutil.which(given or "ffmpeg")
    if not found:
        raise FileNotFoundError("ffmpeg is not installed")
    return found


def window_names(chunks: DataFrame, suffix: str = "mp3") -> DataFrame:
    """The file of each window: chart, number and measures."""
    name = F.format_string("%s/%s_%03d_%d-%d." + suffix, text.safe_name(F.col("chart_name")), text.safe_name(F.col("chart_name")), F.col("chunk_index"), F.col("start_measure"), F.col("end_measure"))
    return chunks.withColumn("audio_name", name)


def cut(windows: DataFrame, folder: str, given: str | None = None, keep_existing: bool = True) -> DataFrame:
    """Cut windows (key, audio_file, audio_name, start_seconds, end_seconds) into a shared folder: key, file, size, sha1, error.

    Each file is written beside its place and moved there when whole, so a task that runs again does no harm."""
    tool = program(given)

    def run(batches):
        import hashlib

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                target = os.path.join(folder, r["audio_name"])
                error = None
                if not (keep_existing and os.path.exists(target)):
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    part = f"{target}.{uuid.uuid4().hex}{os.path.splitext(target)[1]}"
                    done = subprocess.run([tool, "-v", "error", "-y", "-ss", f"{max(0.0, r['start_seconds']):.6f}", "-t", f"{r['end_seconds'] - r['start_seconds']:.6f}", "-i", r["audio_file"], "-vn", part], capture_output=True, text=True)
                    if done.returncode:
                        error = done.stderr[-300:] or "failed"
                    else:
                        os.replace(part, target)
                data = open(target, "rb").read() if error is None else b""
                rows.append({"key": r["key"], "file": target, "size": len(data), "sha1": hashlib.sha1(data).hexdigest() if error is None else None, "error": error})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.string()), ("file", pa.string()), ("size", pa.int64()), ("sha1", pa.string()), ("error", pa.string())]))

    return windows.select("key", "audio_file", "audio_name", "start_seconds", "end_seconds").mapInArrow(run, "key string, file string, size bigint, sha1 string, error string")


def metadata(files: DataFrame) -> DataFrame:
    """path, size and SHA-1 of binary files (columns path, content)."""
    return files.select("path", F.length("content").cast("bigint").alias("size"), F.sha1("content").alias("sha1"))
