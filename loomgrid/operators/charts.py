"""Charts as DataFrames: slots, notes and measures, compiled once for each chart by Arrow batches.

A chart that cannot be read gives a row with `error` and no other value, so one bad chart fails no
task. All of a chart is compiled in one call; charts are spread by the input's partitions, without a
shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import notation, timeline

COUNTERS = notation.COUNTERS
MOMENT = "struct<local_seconds:double,local_beat:double,bpm:double,all:array<int>,hand:array<int>,taps:array<int>>"
MEASURES = (
    "chart_id string, idx int, start_seconds double, end_seconds double, duration_seconds double, beats double, bpm double, ended_by string, "
    f"start_slot int, end_slot int, text string, {', '.join(f'{c} bigint' for c in COUNTERS)}, moments array<{MOMENT}>, paths array<array<int>>, error string"
)
SLOTS = "chart_id string, slot int, raw string, notes string, start_seconds double, end_seconds double, duration_seconds double, beats double, bpm double, divider double, exact_seconds double, error string"
NOTES = "chart_id string, slot int, pseudo int, each int, kind string, raw string, lane int, weight int, counts map<string,int>, paths array<array<int>>, error string"


def _by_chart(charts: DataFrame, schema: str, rows_of) -> DataFrame:
    """Rows of each chart (chart_id, content, first_seconds); an exception becomes a row with the error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            rows = []
            for chart, content, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [{"chart_id": chart, **r} for r in rows_of(content or "", first or 0.0)]
                except (ValueError, ZeroDivisionError) as e:
                    rows.append({"chart_id": chart, "error": str(e) or type(e).__name__})
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    first = F.col("first_seconds") if "first_seconds" in charts.columns else F.lit(0.0)
    return charts.select(F.col("chart_id").cast("string"), "content", first.cast("double").alias("first_seconds")).mapInArrow(run, schema)


def measures(charts: DataFrame) -> DataFrame:
    """One row per measure with its text, counters, moments (local times and lanes) and slide paths."""

    def rows(content, first):
        for m in timeline.compile_chart(content, first).measures:
            counts, moments, paths = timeline.replay(m.text, m.bpm)
            yield {
                "idx": m.index, "start_seconds": m.start, "end_seconds": m.end, "duration_seconds": m.end - m.start, "beats": m.beats, "bpm": m.bpm,
                "ended_by": m.ended_by, "start_slot": m.slots[0].index, "end_slot": m.slots[-1].index, "text": m.text, **counts, "moments": moments, "paths": paths,
            }

    return _by_chart(charts, MEASURES, lambda content, first: list(rows(content, first)))


def slots(charts: DataFrame) -> DataFrame:
    """One row per slot of the normalised timeline."""

    def rows(content, first):
        for s in timeline.compile_chart(content, first).slots:
            yield {"slot": s.index, "raw": s.raw, "notes": s.notes, "start_seconds": s.start, "end_seconds": s.start + s.seconds, "duration_seconds": s.seconds, "beats": s.beats, "bpm": s.bpm, "divider": s.divider, "exact_seconds": s.exact}

    return _by_chart(charts, SLOTS, lambda content, first: list(rows(content, first)))


def notes(charts: DataFrame) -> DataFrame:
    """One row per note, read strictly: a chart without its end mark is an error."""
    return _by_chart(charts, NOTES, lambda content, first: notation.count_notes(content)[1])


def remarks(charts: DataFrame) -> DataFrame:
    """chart_id, remark: what the compiler supplied or moved."""
    return _by_chart(charts, "chart_id string, remark string, error string", lambda content, first: [{"remark": r} for r in timeline.compile_chart(content, first).remarks])


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and (chart_id, error) of the bad ones."""
    return df.where("error is null").drop("error"), df.where("error is not null").select("chart_id", "error").distinct()


def note_counts(notes_of: DataFrame) -> DataFrame:
    """All counters of each chart from its notes; slots and groups are counted from their numbers."""
    value = lambda c: F.coalesce(F.try_element_at("counts", F.lit(c)), F.lit(0))
    plain = [c for c in COUNTERS if c not in ("slots", "empty_slots", "each_groups", "pseudo_each_groups", "density_weight", "non_touch_density_weight")]
    group = notes_of.groupBy("chart_id", "slot", "pseudo").agg(*(F.sum(value(c)).cast("bigint").alias(c) for c in plain), F.sum("weight").cast("bigint").alias("density_weight"), F.count("*").alias("n"))
    return group.groupBy("chart_id").agg(*(F.sum(c).alias(c) for c in plain), F.sum("density_weight").alias("density_weight"), F.sum((F.col("n") > 1).cast("bigint")).alias("each_groups"))


def fields(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, field, value of `&key=value` documents; lines without a key continue the field before, the last of equal keys counts. Built-ins only."""
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^﻿", "")
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.regexp_replace(clean, "\r\n?", "\n")), r"\n(?=&[^=\s]+=)"), lambda p: p.startswith("&"))
    rows = documents.select(F.col(key), F.posexplode(parts).alias("i", "p"))
    rows = rows.select(key, "i", F.regexp_extract("p", r"^&([^=\s]+)=", 1).alias("field"), F.regexp_replace(F.regexp_replace("p", r"^&[^=\s]+=", ""), r"^\s+|\s+$", "").alias("value"))
    return rows.groupBy(key, "field").agg(F.max_by("value", "i").alias("value"))


def first_seconds(fields_of: DataFrame, key: str, difficulties: list[str]) -> DataFrame:
    """key, difficulty, first_seconds and which field it comes from."""
    at = fields_of.where(F.col("field").startswith("first") & (F.trim("value") != "")).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("m"))
    rows = fields_of.select(key).distinct().join(at, key, "left").withColumn("difficulty", F.explode(F.array(*map(F.lit, difficulties))))
    own = F.try_element_at("m", F.concat(F.lit("first_"), F.col("difficulty")))
    song = F.try_element_at("m", F.lit("first"))
    return rows.select(key, "difficulty", F.coalesce(own.try_cast("double"), song.try_cast("double"), F.lit(0.0)).alias("first_seconds"), F.when(own.isNotNull(), F.concat(F.lit("first_"), F.col("difficulty"))).when(song.isNotNull(), "first").otherwise("default").alias("origin"))


def normalised(documents: DataFrame, column: str) -> DataFrame:
    """The column in Unicode normal form C, trimmed; there is no built-in for it."""
    import unicodedata

    import pandas as pd

    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x.strip()))

    return documents.withColumn(column, nfc(F.col(column)))
