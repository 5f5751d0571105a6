"""Writing tables, documents and split files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import integrity

MODES = ("overwrite", "append")


def table(df: DataFrame, path: str, mode: str = "overwrite", keys: list[str] | None = None, partition: list[str] | None = None, references: tuple[DataFrame, str] | None = None) -> None:
    """Write Parquet after its checks: no key twice, every reference there."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if keys and (bad := integrity.duplicates(df, *keys).limit(3).collect()):
        raise ValueError(f"keys that are there twice: {bad}")
    if references and (bad := integrity.missing(df, references[0], references[1]).select(references[1]).limit(3).collect()):
        raise ValueError(f"references to nothing: {bad}")
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def tables(frames: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Several tables below a folder."""
    for name, df in frames.items():
        table(df, f"{root}/{name}", mode)


def chart_json(measures: DataFrame, charts: DataFrame, path: str) -> None:
    """One JSON line per chart with its measures in order: seconds to 6 places, beats to 9."""
    m = F.struct("idx", F.round("start_seconds", 6).alias("start_seconds"), F.round("end_seconds", 6).alias("end_seconds"), F.round("duration_seconds", 6).alias("duration_seconds"), F.round("beats", 9).alias("beats"), "bpm", "ended_by", "text")
    rows = measures.groupBy("chart_id").agg(F.array_sort(F.collect_list(m)).alias("measures"))
    charts.join(rows, "chart_id").withColumn("measure_count", F.size("measures")).write.mode("overwrite").json(path)


def measure_csv(measures: DataFrame, path: str) -> None:
    """Measures as CSV with seconds of six places."""
    six = lambda c: F.format_string("%.6f", c).alias(c)
    measures.select("chart_id", "idx", six("start_seconds"), six("end_seconds"), six("duration_seconds"), "beats", "bpm", "ended_by").write.mode("overwrite").option("header", "true").csv(path)


def split_csv(rows: DataFrame, root: str, order: list[str]) -> None:
    """One folder of CSV for each split, and one of all. Files follow each other in the order; small splits are one file."""
    for (split,) in sorted(rows.select("split").distinct().collect()):
        rows.where(F.col("split") == split).orderBy(*order).write.mode("overwrite").option("header", "true").csv(f"{root}/{split}")
    rows.orderBy("split", *order).write.mode("overwrite").option("header", "true").csv(f"{root}/all")


def ranges_json(index: DataFrame, path: str) -> None:
    """Chunk ranges of each chart as nested lists."""
    index.select("chart_id", "chunk_ranges").write.mode("overwrite").json(path)


def errors(df: DataFrame, path: str) -> int:
    """Write the rows that could not be read, and say how many there are."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def dry_run(df: DataFrame, key: str, vector: str | None = None) -> DataFrame:
    """One row of what would be written: rows, first and last key, vector sizes."""
    sizes = [F.array_sort(F.collect_set(F.size(vector))).alias("dimensions")] if vector else []
    return df.agg(F.count("*").alias("rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), *sizes)
