"""Whole products of a chart library: the score table, section reports, and the vector, index, section and audio tables.

`charts` has chart_id, content and first_seconds, and whatever of the metadata columns there is. Every
product returns lazy DataFrames and, where charts are read, the errors of those that could not be. Charts
are compiled once: tables that are read several times are written to the shared folder unless `cut` says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats, text
from ..plans.lineage import cut as written
from . import charts as chart_ops
from . import chunks, density, embedding, integrity, scoring, segments

METADATA = ("song_id", "title", "artist", "genre", "version", "chart_kind", "difficulty", "level", "charter")
#: Columns of the score table file, in their order.
SCORE_COLUMNS = (
    "song_id", "title", "chart_kind", "difficulty_index", "difficulty_name", "level", "measure_count", "duration_seconds", "total_notes", "burst_density", "burst_note_count",
    "burst_duration_seconds", "burst_start_measure", "burst_end_measure", "note_score", "peak_score", "charge_score", "slide_score", "handtrip_score", "tricky_score", "dominant_dimension", "source_file",
)
KEYS = ["chart_id", "segment_id"]
Cut = Callable[[DataFrame, str], DataFrame]


def kept(df: DataFrame, label: str) -> DataFrame:
    """No cut: the plan is computed again wherever it is read."""
    return df


def measured(charts: DataFrame, cut: Cut = written) -> tuple[DataFrame, DataFrame]:
    """Measures with densities, and errors. `cut` may write them once, since most products read them several times."""
    rows = cut(chart_ops.measures(charts), "measures")
    good, bad = chart_ops.split_errors(rows)
    return density.with_densities(good), bad


def score_table(charts: DataFrame, cut: Cut = written) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of every chart with its raw features and metadata, the baselines they are held against, and errors."""
    m, bad = measured(charts, cut)
    features = cut(scoring.summarize(m, ["chart_id"]), "features")
    base = scoring.baselines(features)
    known = charts.select("chart_id", *(c for c in METADATA if c in charts.columns))
    return scoring.scores(features, base).join(known, "chart_id"), base, bad


def score_file(table: DataFrame) -> DataFrame:
    """The score table in the columns of its file; what is not known is null."""
    given = {"difficulty_index": "difficulty", "burst_duration_seconds": "burst_seconds"}
    column = lambda c: F.col(given.get(c, c)) if given.get(c, c) in table.columns else F.lit(None).cast("string")
    return table.select(*(column(c).alias(c) for c in SCORE_COLUMNS))


def intermediates(table: DataFrame) -> DataFrame:
    """Raw features, scores and the dominant dimension of each chart as nested columns."""
    raw = ["density_note_mean", "density_peak_q90", "density_cv", "burst_density", "burst_note_count", "slide_ratio", "slide_density", "charge_ratio", "charge_density", "handtrip_density", "tricky_shortest_time"]
    return table.select("chart_id", "measure_count", "duration_seconds", "total_notes", F.struct(*raw).alias("raw"), F.struct(*(F.col(f"{n}_score").alias(n) for n in stats.SCORES)).alias("scores"), "dominant_dimension")


def reports(charts: DataFrame, base: DataFrame | None = None, standards: DataFrame | None = None, config: segments.Config = segments.Config(), cut: Cut = written) -> tuple[DataFrame, DataFrame]:
    """Sections of every chart: bounds, raw features, label, tier and scores (to six places). Without baselines they are those of the charts given."""
    m, bad = measured(charts, cut)
    plan = segments.segmentation(m, config)
    rows = cut(segments.assign(m, plan), "sections")
    limits = segments.thresholds(m)
    features = cut(scoring.summarize(rows, KEYS), "section-features")
    if base is None:
        base = scoring.baselines(scoring.summarize(m, ["chart_id"]))
    by_level = segments.nearest_standard(charts.select("chart_id", "level"), standards) if standards is not None and "level" in charts.columns else None
    marked = segments.labels(segments.states(rows, limits, KEYS), limits, features.select(*KEYS, "burst_density", "window_size", "measure_count"), KEYS, by_level)
    out = scoring.scores(features, base).join(marked.select(*KEYS, "label", "base_label", "steady_tier", "has_burst"), KEYS)
    return out.withColumns({f"{n}_score": F.round(f"{n}_score", 6) for n in stats.SCORES}), bad


def tables(charts: DataFrame, sections: DataFrame, cut: Cut = written, features: int = 0) -> dict[str, DataFrame]:
    """The pattern, index and segment tables of charts and their sections."""
    m, _ = measured(charts, cut)
    counts = m.groupBy("chart_id").agg(F.max("idx").alias("measure_count"))
    known = charts.select("chart_id", *(c for c in METADATA if c in charts.columns))
    if {"song_id", "chart_kind", "difficulty", "title"} <= set(known.columns):
        named = known.withColumn("chart_name", text.chart_name(F.col("song_id"), F.col("chart_kind"), F.col("difficulty"), F.col("title")))
    else:
        named = known.withColumn("chart_name", text.safe_name(F.col("chart_id")))
    spec = chunks.chunks(sections.select(*KEYS, F.col("start_measure").cast("int"), F.col("end_measure").cast("int")).join(counts, "chart_id"))
    spec = cut(chunks.keyed(spec, named).withColumn("measure_weights", chunks.weights()), "chunks")
    vector = embedding.embed(embedding.window_measures(spec, m), features=features)
    extra = [c for c in named.columns if c not in ("chart_id", "chart_name")]
    pattern = spec.join(vector, "key").join(named.select("chart_id", *extra), "chart_id").withColumns({"measure_range": F.concat_ws("-", "start_measure", "end_measure"), "body_range": F.concat_ws("-", "body_start_measure", "body_end_measure"), "embedding_dimension": F.size("vector")})
    index = chunks.index(spec).join(named, "chart_id").join(counts, "chart_id")
    if "level" in index.columns:
        index = index.withColumn("level_value", F.coalesce(stats.level_value("level", 0.6), F.lit(0.0)))
    return {"pattern": pattern, "index": index, "segments": chunks.segment_rows(sections).withColumnRenamed("segment_key", "key")}


def audio_table(pattern: DataFrame, measures: DataFrame, audio: DataFrame) -> DataFrame:
    """Audio rows with the same keys as the pattern table: file, start and end seconds of each window; charts without audio are left out."""
    rows = chunks.spans(pattern.select("key", "chart_id", "segment_id", "segment_key", "chunk_index", "start_measure", "end_measure"), measures)
    return rows.join(audio.where("audio_file is not null").select("chart_id", "audio_file", "audio_format"), "chart_id")


def migrate(table: DataFrame, spec: DataFrame) -> DataFrame:
    """A table of windows with segment_id and segment_key brought up to date by key; columns it lacks are added."""
    return integrity.upsert(table, spec.select("key", "segment_id", "segment_key"), "key")


def field_counts(documents: DataFrame, key: str, column: str) -> DataFrame:
    """Counters of every `inote_*` field of documents: key, field and the counters, or an error."""
    f = chart_ops.fields(documents, key, column).where(F.col("field").startswith("inote_"))
    rows = f.select(F.concat_ws("\u0001", F.col(key).cast("string"), "field").alias("chart_id"), F.col("value").alias("content"))
    parsed = chart_ops._by_chart(rows, "chart_id string, " + ", ".join(f"{c} bigint" for c in chart_ops.COUNTERS) + ", error string", lambda content, _: [chart_ops.notation.count_notes(content)[0]])
    part = F.split("chart_id", "\u0001")
    return parsed.select(F.get(part, F.lit(0)).alias(key), F.get(part, F.lit(1)).alias("field"), *chart_ops.COUNTERS, "error")
