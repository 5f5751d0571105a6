"""Overlapping four-measure windows of sections, and the tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

BODY, CHUNK = 3, 4


def chunks(segments: DataFrame) -> DataFrame:
    """Windows of sections (chart_id, segment_id, start_measure, end_measure, measure_count): bodies of three measures, the last one moved back to end with the section, each with one measure more after it or, at the chart's end, before it.

    Of windows in a row that are alike the last stays. Charts of fewer than four measures have none."""
    length = F.col("end_measure") - F.col("start_measure") + 1
    whole = F.sequence(F.col("start_measure"), F.greatest(F.col("start_measure"), F.col("end_measure") - (BODY - 1)), F.lit(BODY))
    starts = F.when(length <= BODY, F.array("start_measure")).otherwise(F.array_distinct(F.concat(whole, F.array(F.col("end_measure") - (BODY - 1)))))
    rows = segments.where(F.col("measure_count") >= CHUNK).select("chart_id", "segment_id", "measure_count", "end_measure", F.explode(starts).alias("body_start"))
    rows = rows.withColumn("body_end", F.least(F.col("end_measure"), F.col("body_start") + (BODY - 1)))
    rows = rows.withColumn("end", F.least(F.col("measure_count"), F.col("body_start") + (CHUNK - 1))).withColumn("start", F.col("end") - (CHUNK - 1))
    rows = rows.withColumns({"start": F.greatest(F.lit(1), F.col("start")), "end": F.greatest(F.lit(CHUNK), F.col("end"))})
    w = Window.partitionBy("chart_id").orderBy("segment_id", "body_start")
    following = F.lead(F.struct("start", "end")).over(w)
    rows = rows.withColumn("_next", following).where(F.col("_next").isNull() | (F.col("_next.start") != F.col("start")) | (F.col("_next.end") != F.col("end")))
    return rows.select("chart_id", "segment_id", F.row_number().over(w).alias("chunk_index"), F.col("start").alias("start_measure"), F.col("end").alias("end_measure"), F.col("body_start").alias("body_start_measure"), F.col("body_end").alias("body_end_measure"), overlap_slots().alias("overlap_slots"))


def overlap_slots():
    """Places in a window (0 to 3) that are not of its body."""
    return F.filter(F.sequence(F.lit(0), F.lit(CHUNK - 1)), lambda i: ~(F.col("start") + i).between(F.col("body_start"), F.col("body_end")))


def weights(overlap: str = "overlap_slots", weight: float = 0.5):
    """Weight of each measure of a window: overlapping ones count half; without a list, the last one does."""
    given = F.coalesce(F.col(overlap), F.array(F.lit(CHUNK - 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(CHUNK - 1)), lambda i: F.when(F.array_contains(given, i), weight).otherwise(1.0))


def keyed(chunk: DataFrame, charts: DataFrame) -> DataFrame:
    """Windows with chart_name, key and segment_key; `charts` has chart_id and chart_name."""
    rows = chunk.join(charts.select("chart_id", "chart_name"), "chart_id")
    return rows.withColumns({"key": text.chunk_key(F.col("chart_name"), F.col("start_measure"), F.col("end_measure")), "segment_key": text.segment_key(F.col("chart_id"), F.col("segment_id"))})


def index(chunk: DataFrame) -> DataFrame:
    """One row per chart: its number of windows, first and last key, and the ranges in order."""
    order = F.array_sort(F.collect_list(F.struct("chunk_index", "start_measure", "end_measure")))
    out = chunk.groupBy("chart_id").agg(F.count("*").alias("chunk_count"), F.countDistinct("segment_id").alias("segment_count"), F.min_by("key", "chunk_index").alias("first_chunk_key"), F.max_by("key", "chunk_index").alias("last_chunk_key"), order.alias("o"))
    return out.withColumn("chunk_ranges", F.transform("o", lambda x: F.array(x["start_measure"], x["end_measure"]))).drop("o")


def spans(chunk: DataFrame, measures: DataFrame) -> DataFrame:
    """Start and end seconds of windows: of their first and last measure."""
    m = measures.select("chart_id", "idx", "start_seconds", "end_seconds")
    rows = chunk.join(m, "chart_id").where(F.col("idx").between(F.col("start_measure"), F.col("end_measure")))
    out = rows.groupBy("chart_id", "chunk_index").agg(F.min_by("start_seconds", "idx").alias("start_seconds"), F.max_by("end_seconds", "idx").alias("end_seconds"))
    return chunk.join(out, ["chart_id", "chunk_index"], "left").withColumn("duration_seconds", F.col("end_seconds") - F.col("start_seconds"))


def segment_rows(scored: DataFrame) -> DataFrame:
    """Sections as table rows: key, six scores and the scores as a vector. Charts without exactly five sections are left out; see bad_charts()."""
    names = [f"{n}_score" for n in ("note", "peak", "charge", "slide", "handtrip", "tricky")]
    n = F.count("*").over(Window.partitionBy("chart_id"))
    rows = scored.withColumn("_n", n).where("_n = 5").drop("_n")
    return rows.select("chart_id", "segment_id", text.segment_key(F.col("chart_id"), F.col("segment_id")).alias("segment_key"), "start_measure", "end_measure", "label", *names, F.array(*(F.col(c).cast("float") for c in names)).alias("score_vector"))


def bad_charts(scored: DataFrame) -> DataFrame:
    """Charts that do not have exactly five sections."""
    return scored.groupBy("chart_id").count().where("count <> 5")
