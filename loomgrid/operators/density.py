"""Densities, movement and sequence features of measures.

`measures` has chart_id, idx (from 1), duration_seconds, beats and counters; `moments` has chart_id,
idx, time_seconds, beat, bpm and lanes. All windows are partitioned by chart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ring, stats

SHORT_MEASURE = 0.4  # seconds; shorter measures are not part of a density profile
SIXTEENTH, TWELFTH, FAST_BPM = 0.25, 1 / 3, 200.0
BURST_WINDOW = 4
LANE_LISTS = ("all", "hand", "taps")


def with_densities(measures: DataFrame) -> DataFrame:
    """Weights per second, with and without touches."""
    return measures.withColumns({"density": stats.per_second("density_weight", "duration_seconds"), "non_touch_density": stats.per_second("non_touch_density_weight", "duration_seconds")})


def in_range(measures: DataFrame, first: int, last: int) -> DataFrame:
    """Measures of a closed range of numbers."""
    if first < 1 or last < first:
        raise ValueError("invalid measure range")
    return measures.where(F.col("idx").between(first, last))


def range_density(measures: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds, number, weight, seconds and density of each group of measures."""
    out = measures.groupBy(*keys).agg(F.min("idx").alias("start_measure"), F.max("idx").alias("end_measure"), F.count("*").alias("measure_count"), F.sum("density_weight").alias("weighted_sum"), F.sum("duration_seconds").alias("duration_seconds"))
    return out.withColumn("density", stats.per_second("weighted_sum", "duration_seconds"))


def note_mix(counts: DataFrame) -> DataFrame:
    """Counts and shares of taps, slides, holds (with held touches) and touches, and of breaks and protected notes."""
    hold = F.col("hold") + F.col("touch_hold")
    mix = F.col("tap") + F.col("slide") + hold + F.col("touch")
    total = F.col("tap") + F.col("hold") + F.col("slide") + F.col("touch") + F.col("touch_hold")
    out = {"total": total, "hold_count": hold, "tap_ratio": stats.ratio("tap", mix), "slide_ratio": stats.ratio("slide", mix), "hold_ratio": stats.ratio(hold, mix), "touch_ratio": stats.ratio("touch", mix)}
    if "break_notes" in counts.columns:
        out |= {"break_ratio": stats.ratio("break_notes", total), "protected_ratio": stats.ratio("protected_notes", total)}
    return counts.withColumns(out)


def button_distribution(counts: DataFrame) -> DataFrame:
    """Mean, population variance and the like of the eight buttons' counts."""
    n = F.array(*(F.col(f"button_{i}").cast("double") for i in range(1, 9)))
    mean = F.aggregate(n, F.lit(0.0), lambda s, x: s + x) / 8
    out = counts.withColumns({"button_mean": mean, "button_min": F.array_min(n), "button_max": F.array_max(n)})
    out = out.withColumn("button_variance", F.aggregate(F.transform(n, lambda x: (x - F.col("button_mean")) * (x - F.col("button_mean"))), F.lit(0.0), lambda s, x: s + x) / 8)
    return out.withColumns({"button_stdev": F.sqrt("button_variance"), "button_cv": stats.ratio(F.sqrt("button_variance"), "button_mean"), "button_variance_ratio": stats.ratio("button_variance", F.col("button_mean") * F.col("button_mean"))})


def all_moments(measures: DataFrame, keys: list[str]) -> DataFrame:
    """Moments with times and beats counted from the start of each group's first measure (durations of the measures before, then the place in the measure), with all their lanes: all, hand, taps."""
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    at = measures.withColumns({"_s": F.coalesce(F.sum("duration_seconds").over(w), F.lit(0.0)), "_b": F.coalesce(F.sum("beats").over(w), F.lit(0.0))})
    rows = at.select(*keys, "idx", "_s", "_b", F.posexplode("moments").alias("k", "m"))
    return rows.select(*keys, "idx", "k", (F.col("_s") + F.col("m.local_seconds")).alias("time_seconds"), (F.col("_b") + F.col("m.local_beat")).alias("beat"), F.col("m.bpm").alias("bpm"), *(F.col(f"m.{x}").alias(x) for x in LANE_LISTS))


def with_lanes(moments: DataFrame, lanes: str = "all") -> DataFrame:
    """The moments that have lanes of one list."""
    return moments.where(F.size(lanes) > 0).withColumn("lanes", F.col(lanes)).drop(*LANE_LISTS)


def moments_of(measures: DataFrame, keys: list[str], lanes: str = "all") -> DataFrame:
    """with_lanes of all_moments."""
    return with_lanes(all_moments(measures, keys), lanes)


def movement(moments: DataFrame, keys: list[str], twelfths: bool = False) -> DataFrame:
    """Distance between consecutive moments further apart than a sixteenth (with `twelfths`, a twelfth where the tempo is above 200)."""
    w = Window.partitionBy(*keys).orderBy("time_seconds", "beat", "idx", "k")
    rows = moments.withColumn("_a", F.array_sort("lanes")).withColumn("_now", F.struct(F.col("_a").alias("lanes"), ring.lane_center(F.col("_a")).alias("center"), "beat", "bpm"))
    rows = rows.withColumn("_was", F.lag("_now").over(w))  # sorted lanes and centres are found once for each moment
    fast = (F.greatest(F.coalesce("bpm", F.lit(0.0)), F.coalesce("_was.bpm", F.lit(0.0))) > FAST_BPM) if twelfths else F.lit(False)
    pair = F.col("_was").isNotNull()
    apart = pair & (F.col("beat") - F.col("_was.beat") > F.when(fast, TWELFTH).otherwise(SIXTEENTH))
    rows = rows.withColumn("_d", F.when(apart, ring.sorted_distance(F.col("_was.lanes"), F.col("_now.lanes"), F.col("_was.center"), F.col("_now.center"))))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("moment_count"),
        F.count("_d").alias("pair_count"),
        F.sum((pair & ~apart).cast("bigint")).alias("skipped_count"),
        F.sum((pair & fast).cast("bigint")).alias("fast_pair_count"),
        F.coalesce(F.sum("_d"), F.lit(0.0)).alias("total_distance"),
        F.coalesce(F.max("_d"), F.lit(0.0)).alias("max_pair_distance"),
    )


def slide_movement(measures: DataFrame, keys: list[str]) -> DataFrame:
    """Number of slide paths and their distances."""
    rows = measures.select(*keys, F.explode_outer("paths").alias("path")).withColumn("_d", F.when(F.col("path").isNotNull(), ring.path_distance(F.col("path"))))
    return rows.groupBy(*keys).agg(F.count("_d").alias("path_count"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("total_distance"), F.coalesce(F.max("_d"), F.lit(0.0)).alias("max_path_distance"))


def shortest_triple(moments: DataFrame, keys: list[str]) -> DataFrame:
    """The shortest time of three taps of one button; taps at one beat of one button count once; among equals the lowest button, then the earliest."""
    taps = moments.select(*keys, "time_seconds", F.round("beat", 9).alias("beat"), F.explode(F.array_distinct("lanes")).alias("lane")).where(F.col("lane").between(1, 8))
    taps = taps.groupBy(*keys, "lane", "beat").agg(F.min("time_seconds").alias("time_seconds"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "lane").orderBy("time_seconds", "beat")
    taps = taps.withColumn("_end", F.lead("time_seconds", 2).over(w))
    best = F.min(F.when(F.col("_end").isNotNull(), F.struct((F.col("_end") - F.col("time_seconds")).alias("t"), "lane", "time_seconds", "_end")))
    out = taps.groupBy(*keys).agg(best.alias("b"), F.count("_end").alias("window_count"), F.sum(F.col("n") - 1).alias("deduplicated_count"))
    return out.select(*keys, F.col("b.t").alias("shortest_time_seconds"), F.col("b.lane").alias("lane"), F.col("b.time_seconds").alias("start_seconds"), F.col("b._end").alias("end_seconds"), "window_count", "deduplicated_count")


def burst(measures: DataFrame, keys: list[str], window: int = BURST_WINDOW) -> DataFrame:
    """The densest `window` measures in a row by taps and holds per second, or all measures if there are fewer; the earliest among equals."""
    part = Window.partitionBy(*keys)
    frame = part.orderBy("idx").rowsBetween(0, window - 1)
    hits = (F.col("tap") + F.col("hold")).cast("bigint")
    rows = measures.select(*keys, "idx", "duration_seconds", hits.alias("_hits")).withColumns(
        {
            "_n": F.count("*").over(frame), "_all": F.count("*").over(part), "note_count": F.sum("_hits").over(frame),
            "burst_seconds": F.sum("duration_seconds").over(frame), "end_measure": F.max("idx").over(frame), "_first": F.min("idx").over(part),
        }
    )
    rows = rows.where((F.col("_n") == window) | ((F.col("_all") < window) & (F.col("idx") == F.col("_first")))).withColumn("density", stats.per_second("note_count", "burst_seconds"))
    best = F.max(F.struct("density", (-F.col("idx")).alias("i"), "note_count", "burst_seconds", "end_measure", F.col("_n").alias("w"))).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, F.col("b.density").alias("burst_density"), F.col("b.note_count").alias("burst_note_count"), F.col("b.burst_seconds").alias("burst_seconds"), F.col("b.w").alias("window_size"), (-F.col("b.i")).alias("start_measure"), F.col("b.end_measure").alias("end_measure"))


def boundary_scores(measures: DataFrame, window: int = BURST_WINDOW) -> DataFrame:
    """How much the density changes at the boundary before each measure but the first (boundary = measures before it).

    Means of the frames on both sides, one and two windows away and over a longer reach; bonuses for the end of a low plateau and for a climb."""
    part = Window.partitionBy("chart_id")
    w = part.orderBy("idx")
    reach = max(3 * window, 10)

    def mean(lo: int, hi: int) -> Column:
        return F.avg("density").over(w.rowsBetween(lo, hi))

    rows = measures.select("chart_id", "idx", "density").withColumns(
        {
            "_left": mean(-window, -1), "_right": mean(0, window - 1), "_before": mean(-2 * window, -window - 1), "_after": mean(window, 2 * window - 1),
            "_far_left": mean(-reach, -1), "_far_right": mean(0, reach - 1), "_mean": F.avg("density").over(part), "_sd": F.stddev_pop("density").over(part), "boundary": F.row_number().over(w) - 1,
        }
    ).where("boundary > 0")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    left, right, before, after, far_left, far_right = (F.col(c) for c in ("_left", "_right", "_before", "_after", "_far_left", "_far_right"))
    step = zero(right) - zero(left)
    broad = F.abs(zero(far_right) - zero(far_left))
    plateau = F.when((far_left <= F.col("_mean") - F.col("_sd") * 0.35) & (right > far_left), (right - far_left) * 0.9 + F.greatest(F.lit(0.0), F.col("_mean") - far_left) * 0.35).otherwise(0.0)
    climbs = (step > 0) & (left - before >= -0.25) & (after - right >= -0.25)
    climb = F.when(climbs, step * 0.55 + broad * 0.25).otherwise(0.0)
    score = F.abs(step) + F.abs(step - (zero(after) - zero(before))) * 0.35 + broad * 0.45 + plateau + climb
    return rows.select("chart_id", F.col("boundary").cast("bigint").alias("boundary"), score.alias("score"))


def smoothed(rows: DataFrame, keys: list[str], value: str, order: str = "idx") -> DataFrame:
    """The mean of each value and its neighbours; fewer than three values stay as they are."""
    part = Window.partitionBy(*keys)
    return rows.withColumn("smooth", F.when(F.count("*").over(part) < 3, F.col(value)).otherwise(F.avg(value).over(part.orderBy(order).rowsBetween(-1, 1))))


def slope(rows: DataFrame, keys: list[str], value: str, order: str = "idx") -> DataFrame:
    """The slope of the values on their place; 0 for fewer than two."""
    placed = rows.withColumn("_x", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return placed.groupBy(*keys).agg(F.coalesce(F.regr_slope(value, "_x"), F.lit(0.0)).alias("slope"))


def transitions(events: DataFrame, keys: list[str]) -> DataFrame:
    """Weights of the steps between consecutive lanes (columns ord, lane, weight): by distance, by direction and by both ends; a step weighs the lesser of its ends."""
    w = Window.partitionBy(*keys).orderBy("ord")
    rows = events.where("lane is not null").withColumns({"_from": F.lag("lane").over(w), "_w": F.least("weight", F.lag("weight").over(w))}).where("_from is not null")
    a, b = F.col("_from"), F.col("lane")
    names = F.array(F.concat(F.lit("distance_"), ring.ring_distance(a, b).cast("int")), F.concat(F.lit("direction_"), ring.direction(a, b)), F.concat(F.lit("step_"), ring.clockwise_steps(a, b)), F.concat(F.lit("pair_"), a, F.lit("_"), b))
    return rows.select(*keys, F.explode(names).alias("feature"), "_w").groupBy(*keys, "feature").agg(F.sum("_w").alias("value"))


def timeline(slots: DataFrame, keys: list[str]) -> DataFrame:
    """Start seconds and beats of slots (ord, bpm, divider; null carries on the value before) by running sums."""
    w = Window.partitionBy(*keys).orderBy("ord")
    carry = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = slots.withColumns({"bpm": F.last("bpm", True).over(carry), "divider": F.coalesce(F.last("divider", True).over(carry), F.lit(4.0))})
    rows = rows.withColumns({"beats": 4.0 / F.col("divider"), "seconds": F.lit(240.0) / F.col("bpm") / F.col("divider")})
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({"start_seconds": F.coalesce(F.sum("seconds").over(past), F.lit(0.0)), "start_beat": F.coalesce(F.sum("beats").over(past), F.lit(0.0))})
