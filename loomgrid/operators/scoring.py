"""Segment summaries, library baselines and the six scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import density

BASELINES = (
    "density_note_mean_p95", "density_peak_q90_p95", "density_cv_p05", "density_cv_p95", "burst_density_p98", "slide_density_p98",
    "slide_ratio_p98", "charge_density_p98", "charge_ratio_p98", "handtrip_density_p98", "tricky_intensity_p98",
)


def profile(measures: DataFrame, keys: list[str]) -> DataFrame:
    """Sums and the density profile of groups of measures; measures under 0.4 seconds count in the sums only."""
    long = F.col("duration_seconds") >= density.SHORT_MEASURE
    of = lambda c: F.when(long, F.col(c))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = measures.groupBy(*keys).agg(
        F.min("idx").alias("start_measure"), F.max("idx").alias("end_measure"), F.count("*").alias("measure_count"),
        F.sum("duration_seconds").alias("duration_seconds"), F.sum("density_weight").alias("weighted_sum"),
        *(F.sum(c).cast("bigint").alias(c) for c in ("tap", "hold", "slide", "touch", "touch_hold")),
        zero(F.avg(of("density"))).alias("mean_measure_density"), zero(F.max(of("density"))).alias("max_measure_density"), zero(F.min(of("density"))).alias("min_measure_density"),
        zero(F.avg(of("non_touch_density"))).alias("density_note_mean"), zero(F.percentile(of("non_touch_density"), F.lit(0.9))).alias("density_peak_q90"), zero(F.stddev_pop(of("non_touch_density"))).alias("density_stdev"),
    )
    total = F.col("tap") + F.col("hold") + F.col("slide") + F.col("touch") + F.col("touch_hold")
    charge = F.col("hold") + F.col("touch_hold")
    return out.withColumns(
        {
            "density": stats.per_second("weighted_sum", "duration_seconds"), "density_cv": F.when(F.col("density_note_mean") > 0, F.col("density_stdev") / F.col("density_note_mean")).otherwise(0.0),
            "total_notes": total, "charge_count": charge, "slide_ratio": stats.ratio("slide", total), "charge_ratio": stats.ratio(charge, total),
            "slide_density": stats.per_second("slide", "duration_seconds"), "charge_density": stats.per_second(charge, "duration_seconds"),
        }
    )


def summarize(measures: DataFrame, keys: list[str]) -> DataFrame:
    """All raw features of groups of measures that have moments and paths: profile, burst, hand trip and shortest triple.

    Moments are placed in time once for the hand trip and the triples; every part is partitioned by the keys."""
    out = profile(measures, keys)
    bursts = density.burst(measures, keys).select(*keys, "burst_density", "burst_note_count", "burst_seconds", F.col("start_measure").alias("burst_start_measure"), F.col("end_measure").alias("burst_end_measure"), "window_size")
    moments = density.all_moments(measures, keys)
    hand = density.movement(density.with_lanes(moments, "hand"), keys, twelfths=True).select(*keys, F.col("total_distance").alias("_hand"))
    slide = density.slide_movement(measures, keys).select(*keys, F.col("total_distance").alias("_slide"), "path_count")
    triple = density.shortest_triple(density.with_lanes(moments, "taps"), keys).select(*keys, F.col("shortest_time_seconds").alias("tricky_shortest_time"))
    for part in (bursts, hand, slide, triple):
        out = out.join(part, keys, "left")
    trip = F.coalesce("_hand", F.lit(0.0)) + F.coalesce("_slide", F.lit(0.0))
    return out.withColumn("handtrip_density", stats.per_second(trip, "duration_seconds")).drop("_hand", "_slide")


def baselines(features: DataFrame) -> DataFrame:
    """One row of percentiles over all charts: exact, one pass."""
    p = lambda c, q: F.coalesce(F.percentile(c, F.lit(q)), F.lit(0.0))
    t = F.col("tricky_shortest_time")
    speed = F.when(t > 0, 1 / F.when(t > 0, t).otherwise(1.0))
    return features.agg(
        F.count("*").alias("chart_count"), p("density_note_mean", 0.95).alias("density_note_mean_p95"), p("density_peak_q90", 0.95).alias("density_peak_q90_p95"),
        p("density_cv", 0.05).alias("density_cv_p05"), p("density_cv", 0.95).alias("density_cv_p95"), p("burst_density", 0.98).alias("burst_density_p98"),
        p("slide_density", 0.98).alias("slide_density_p98"), p("slide_ratio", 0.98).alias("slide_ratio_p98"), p("charge_density", 0.98).alias("charge_density_p98"),
        p("charge_ratio", 0.98).alias("charge_ratio_p98"), p("handtrip_density", 0.98).alias("handtrip_density_p98"), F.coalesce(F.percentile(speed, F.lit(0.98)), F.lit(1.0)).alias("tricky_intensity_p98"),
    )


def check_baselines(row: DataFrame) -> DataFrame:
    """A given one-row table of baselines, if it has all columns."""
    missing = sorted(set(BASELINES) - {"density_peak_q90_p95"} - set(row.columns))
    if missing:
        raise ValueError(f"baselines lack {', '.join(missing)}")
    return row


def scores(features: DataFrame, base: DataFrame) -> DataFrame:
    """The six scores (0 to 200) and the dominant one; `base` is one row."""
    rows = features.crossJoin(F.broadcast(check_baselines(base).select(*(F.col(c).alias("_" + c) for c in base.columns if c in BASELINES))))
    value = {
        "note": stats.note_score("density_note_mean", "density_cv", "_density_note_mean_p95", "_density_cv_p05", "_density_cv_p95"),
        "peak": stats.burst_score("burst_density", "_burst_density_p98"),
        "charge": stats.fused_score("charge_ratio", "charge_density", "_charge_ratio_p98", "_charge_density_p98"),
        "slide": stats.fused_score("slide_ratio", "slide_density", "_slide_ratio_p98", "_slide_density_p98"),
        "handtrip": stats.handtrip_score("handtrip_density", "_handtrip_density_p98"),
        "tricky": stats.tricky_score("tricky_shortest_time", "_tricky_intensity_p98"),
    }
    rows = rows.withColumns({f"{k}_score": v for k, v in value.items()})
    rows = rows.withColumn("dominant_dimension", stats.dominant({k: F.col(f"{k}_score") for k in stats.SCORES}))
    return rows.drop(*("_" + c for c in BASELINES))


def relative_scores(features: DataFrame, chart: str = "chart_id") -> DataFrame:
    """Scores of segments against the percentiles of their own chart; bursts of 0 do not count there, and percentiles of 0 take fixed values."""
    w = Window.partitionBy(chart)
    p = lambda c, q: F.coalesce(F.percentile(c, F.lit(q)).over(w), F.lit(0.0))
    positive = lambda c, default: F.when(c > 0, c).otherwise(default)
    t = F.col("tricky_shortest_time")
    marks = {
        "_mean": p("density_note_mean", 0.95), "_cv05": p("density_cv", 0.05), "_cv95": p("density_cv", 0.95),
        "_burst": F.coalesce(F.percentile(F.when(F.col("burst_density") > 0, F.col("burst_density")), F.lit(0.98)).over(w), F.lit(1.0)),
        "_hand": positive(p("handtrip_density", 0.98), 1.0), "_fast": positive(F.coalesce(F.percentile(F.when(t > 0, 1 / F.when(t > 0, t).otherwise(1.0)), F.lit(0.98)).over(w), F.lit(1.0)), 1.0),
        "_sr": positive(p("slide_ratio", 0.98), 0.20), "_sd": positive(p("slide_density", 0.98), 1.5), "_cr": positive(p("charge_ratio", 0.98), 0.20), "_cd": positive(p("charge_density", 0.98), 1.5),
    }
    rows = features.withColumns(marks).withColumns(
        {
            "note_score": stats.note_score("density_note_mean", "density_cv", "_mean", "_cv05", "_cv95"), "peak_score": stats.burst_score("burst_density", "_burst"),
            "charge_score": stats.fused_score("charge_ratio", "charge_density", "_cr", "_cd"), "slide_score": stats.fused_score("slide_ratio", "slide_density", "_sr", "_sd"),
            "handtrip_score": stats.handtrip_score("handtrip_density", "_hand"), "tricky_score": stats.tricky_score("tricky_shortest_time", "_fast"),
        }
    )
    return rows.drop(*marks)
