"""Cutting charts into sections, and labelling the sections."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import density


@dataclass(frozen=True)
class Config:
    """How charts are cut."""

    min_segments: int = 5
    max_segments: int = 5
    fixed_segments: int | None = 5
    edge: int = 8
    min_measures: int | None = None
    length_factor: float = 1.75
    window: int = 4
    balance_weight: float = 1.0
    extra_penalty: float = 0.35

    def shortest(self, n: int) -> int:
        return max(1, self.min_measures if self.min_measures is not None else min(n // 10, 10))

    def candidates(self, n: int) -> range:
        """Boundaries away from the edges; for short charts only as far as the shortest section."""
        least = self.shortest(n)
        low, high = max(self.edge + 1, least), min(n - self.edge - 1, n - least)
        return range(low, high + 1) if high >= low else range(least, n - least + 1)

    def longest(self, n: int, count: int) -> int:
        return max(self.shortest(n), ceil(n / count * self.length_factor))


def added(start: float, terms: Iterable[float]) -> float:
    """Terms added one by one, as SQL does; sum() corrects its roundings, which breaks ties another way."""
    for term in terms:
        start += term
    return start


def imbalance(n: int, cuts: list[int], count: int) -> float:
    """Mean difference of the sections' lengths from equal ones, relative to those."""
    target = n / count
    return added(0.0, (abs(b - a - target) for a, b in zip([0, *cuts], [*cuts, n], strict=True))) / target / count


def best_cuts(n: int, count: int, score: dict[int, float], config: Config) -> tuple[float, float, list[int]] | None:
    """(score, raw score, cuts): for every last boundary the cuts of the largest sum of scores that keep the lengths; of those the best after the balance penalty.

    Among equals, the first: of equal penalised scores that with the first last boundary, of equal sums that with the first boundary before the last, then before that, and so on."""
    need, least, most = count - 1, config.shortest(n), config.longest(n, count)
    if need < 1:
        return None
    options = config.candidates(n)
    layers: list[dict[int, float]] = [{0: 0.0}]  # for each number of cuts, the largest sum by last boundary
    for k in range(need):
        left = need - k - 1
        following = {}
        for b in options:
            if n - b < left * least or (left == 0 and n - b > most):
                continue
            totals = [total for a, total in layers[-1].items() if least <= b - a <= most]
            if totals:
                following[b] = max(totals) + score.get(b, 0.0)
        layers.append(following)
    found = None
    for last, total in layers[-1].items():
        cuts = [last]
        for layer in layers[-2:0:-1]:  # sums that differ here can be equal at the last boundary; none exceeds it, so what is not less is equal (or NaN)
            rest = [score.get(b, 0.0) for b in cuts]
            cuts.insert(0, next(a for a, before in layer.items() if least <= cuts[0] - a <= most and not added(before, rest) < total))
        lengths = [b - a for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        if min(lengths) < least or min(cuts) <= config.edge or max(cuts) >= n - config.edge:
            continue
        value = total - config.balance_weight * imbalance(n, cuts, count) - config.extra_penalty * (count - config.min_segments)
        if found is None or value > found[0]:
            found = (value, total, cuts)
    return found


def cut(n: int, score: dict[int, float], config: Config = Config()) -> tuple[list[int], float, float, float]:
    """(cuts, score, mean boundary score, imbalance) of a chart of n measures; without valid cuts, even ones."""
    if n == 0:
        return [], 0.0, 0.0, 0.0
    possible = max(1, n // config.shortest(n))
    low = max(1, min(config.fixed_segments or config.min_segments, possible))
    high = max(low, min(config.fixed_segments or config.max_segments, possible))
    plans = [(p, c) for c in range(low, high + 1) if (p := best_cuts(n, c, score, config))]
    if plans:
        (value, total, cuts), count = max(plans, key=lambda x: x[0][0])
        return cuts, value, total / (count - 1), imbalance(n, cuts, count)
    cuts = sorted({max(1, min(n - 1, round(n / low * k))) for k in range(1, low)})
    return cuts, 0.0, 0.0, imbalance(n, cuts, len(cuts) + 1)


def segmentation(measures: DataFrame, config: Config = Config()) -> DataFrame:
    """chart_id, segment_id, start_measure, end_measure (numbers from 1), score, boundary_score, imbalance.

    Boundary scores are windows; a chart's cuts are found from the list of its scores, some hundred numbers."""
    scores = density.boundary_scores(measures, config.window).groupBy("chart_id").agg(F.collect_list("boundary").alias("b"), F.collect_list("score").alias("s"))
    size = measures.groupBy("chart_id").agg(F.count("*").cast("int").alias("n"), F.min("idx").alias("first"))
    kind = dict(measures.dtypes)["chart_id"]
    names = ["chart_id", "segment_id", "start_measure", "end_measure", "score", "boundary_score", "imbalance"]

    def run(batches):
        for batch in batches:
            rows = []
            for chart, n, first, boundaries, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cuts, value, mean, off = cut(n, dict(zip(boundaries or (), values or (), strict=True)), config)
                edges = [0, *cuts, n]
                rows += [(chart, k, a + first, b + first - 1, value, mean, off) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names)

    rows = size.join(scores, "chart_id", "left").select("chart_id", "n", "first", "b", "s")
    return rows.mapInArrow(run, f"chart_id {kind}, segment_id int, start_measure int, end_measure int, score double, boundary_score double, imbalance double")


def assign(measures: DataFrame, segments: DataFrame) -> DataFrame:
    """Measures with the segment_id of their section: one row of a section for each of its measures, joined by chart and measure."""
    of = lambda c: F.col(c).cast(measures.schema["idx"].dataType)
    s = segments.where("end_measure >= start_measure").select("chart_id", "segment_id", F.explode(F.sequence(of("start_measure"), of("end_measure"))).alias("idx"))
    return measures.join(s, ["chart_id", "idx"]).select(*measures.columns, "segment_id")


def thresholds(measures: DataFrame, chart: str = "chart_id") -> DataFrame:
    """One row per chart: densities that count as rest, low and high, and what counts as a change, from the chart's percentiles."""
    d = F.col("density")
    p = lambda c, q: F.percentile(c, F.lit(q))
    positive = F.when(d > 0, d)
    rows = measures.groupBy(chart).agg(
        p(d, 0.25).alias("q25"), p(d, 0.75).alias("q75"), p(d, 0.20).alias("p20"), F.stddev_pop(d).alias("sd"),
        F.coalesce(p(positive, 0.33), p(d, 0.33)).alias("low"), F.coalesce(p(positive, 0.67), p(d, 0.67)).alias("high"),
    )
    spread, sd = F.col("q75") - F.col("q25"), F.col("sd")
    most = lambda floor, a, b=None: F.greatest(F.lit(floor), spread * a, *([sd * b] if b else []))
    rest = F.greatest(F.lit(0.25), F.least(F.col("low") * 0.45, F.col("p20")))
    return rows.select(
        chart, rest.alias("rest_max"), F.greatest(rest, "low").alias("low_max"), F.greatest(rest, "high", "low").alias("high_min"), most(0.10, 0.08).alias("flat"), most(0.50, 0.35, 0.45).alias("trend_min"),
        most(0.50, 0.40, 0.70).alias("volatile_sd"), F.lit(0.35).alias("volatile_cv"), most(1.00, 0.90, 1.20).alias("volatile_range"), most(0.75, 0.50, 0.60).alias("burst_lift"), F.lit(1.35).alias("burst_ratio"),
    )


def states(measures: DataFrame, limits: DataFrame, keys: list[str], chart: str = "chart_id") -> DataFrame:
    """Statistics of each section's density curve: the mean weighted by duration on the values as they are, spread and trend on the smoothed ones."""
    w = Window.partitionBy(*keys).orderBy("idx")
    seconds = F.when(F.col("duration_seconds") > 0, F.col("duration_seconds")).otherwise(1.0)
    rows = density.smoothed(measures.withColumn("_t", seconds), keys, "density").join(limits.select(chart, "rest_max", "flat"), chart)
    rows = rows.withColumn("_step", F.col("smooth") - F.lag("smooth").over(w))
    rows = rows.withColumn("_sign", F.when(F.col("_step") > F.col("flat"), 1).when(F.col("_step") < -F.col("flat"), -1).when(F.col("_step").isNotNull(), 0))
    turn = F.last(F.when(F.col("_sign") != 0, F.col("_sign")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"_turn": ((F.col("_sign") != 0) & (turn != F.col("_sign"))).cast("int"), "_place": F.row_number().over(w)})
    idle = (F.col("density_weight") <= 0) | (F.col("density") <= F.col("rest_max"))
    out = rows.groupBy(*keys).agg(
        (F.sum(F.col("density") * F.col("_t")) / F.sum("_t")).alias("mean"), F.stddev_pop("smooth").alias("sd"), F.stddev_pop("density").alias("raw_sd"),
        (F.max("density") - F.min("density")).alias("raw_range"), (F.max("smooth") - F.min("smooth")).alias("range"), (F.max_by("smooth", "idx") - F.min_by("smooth", "idx")).alias("net_change"),
        F.coalesce(F.regr_slope("smooth", "_place"), F.lit(0.0)).alias("slope"), F.count("_sign").alias("_n"), F.sum((F.col("_sign") > 0).cast("int")).alias("_up"), F.sum((F.col("_sign") < 0).cast("int")).alias("_down"),
        F.sum((F.col("_sign") != 0).cast("int")).alias("_moves"), F.sum("_turn").alias("_turns"), (F.sum(F.when(idle, F.col("_t")).otherwise(0.0)) / F.sum("_t")).alias("rest_ratio"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.withColumns(
        {
            "cv": F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(0.0), "raw_cv": F.when(F.col("mean") > 0, F.col("raw_sd") / F.col("mean")).otherwise(0.0),
            "up_ratio": stats.ratio(zero("_up"), "_n"), "down_ratio": stats.ratio(zero("_down"), "_n"), "sign_change_ratio": zero("_turns") / F.greatest(F.lit(1), zero("_moves") - 1),
        }
    ).drop("_n", "_up", "_down", "_moves", "_turns")


def base_label() -> Column:
    """REST, RISING, FALLING, VOLATILE or STEADY from columns of states() and thresholds()."""
    c = F.col
    net, up, down, sign = c("net_change"), c("up_ratio"), c("down_ratio"), c("sign_change_ratio")
    rises = (net >= c("trend_min")) & (((up >= 0.55) & (down <= 0.30)) | ((up >= down + 0.15) & (sign <= 0.55)))
    falls = (-net >= c("trend_min")) & (((down >= 0.55) & (up <= 0.30)) | ((down >= up + 0.10) & (sign <= 0.55)))
    varied = c("cv") >= c("volatile_cv")
    wide = c("range") >= c("volatile_range")
    volatile = ((c("sd") >= c("volatile_sd")) & varied & ((sign >= 0.35) | wide)) | (wide & varied & (sign >= 0.35)) | ((c("raw_cv") >= 0.45) & (c("raw_range") >= c("volatile_range")) & (sign >= 0.50))
    return F.when((c("mean") <= c("rest_max")) | (c("rest_ratio") >= 0.65), "REST").when(rises, "RISING").when(falls, "FALLING").when(volatile, "VOLATILE").otherwise("STEADY")


def nearest_standard(charts: DataFrame, standards: DataFrame) -> DataFrame:
    """Each chart's (chart_id, level) density standard (level, pos, p33, p67, low, high): of its level; below 11 all low, from 15 all high; else of the nearest level, the first among equals.

    The standards are one row for each level: a small table whatever the number of charts."""
    s = standards.select("pos", F.trim("level").alias("s_level"), stats.level_value("level", 0.5).alias("s_value"), "p33", "p67", "low", "high")
    value = stats.level_value("level", 0.5)
    levels = charts.select("level").distinct().withColumn("value", value)
    best = F.min_by(F.struct("s_level", "p33", "p67", "low", "high"), F.struct((F.when(F.trim("level") == F.col("s_level"), 0).otherwise(1)).alias("other"), F.abs(F.col("s_value") - F.col("value")).alias("d"), "pos"))
    same = F.trim("level") == F.col("s_level")
    others = levels.where("value is not null").join(s.select("s_level"), same, "left_anti").crossJoin(s.where("s_value is not null"))  # a few levels, a few standards
    near = levels.join(s, same).unionByName(others).groupBy("level", "value").agg(best.alias("b"))
    exact = F.trim("level").eqNullSafe(F.col("b.s_level"))
    forced = lambda mark, what: F.when(~F.coalesce(exact, F.lit(False)) & (F.col("value") < 11), "all" if what == "low" else "none").when(~F.coalesce(exact, F.lit(False)) & (F.col("value") >= 15), "none" if what == "low" else "all").otherwise(F.col(mark))
    out = levels.join(near.select("level", "b"), "level", "left")
    plain = F.coalesce(exact, F.lit(False)) | F.col("value").between(11, 14.999999)
    out = out.select("level", F.when(exact, "exact").when(F.col("value") < 11, "forced_low").when(F.col("value") >= 15, "forced_high").when(F.col("b").isNotNull(), "nearest").otherwise("none").alias("source"), F.when(plain, F.col("b.s_level")).alias("standard_level"), F.when(plain, F.col("b.p33")).alias("p33"), F.when(plain, F.col("b.p67")).alias("p67"), forced("b.low", "low").alias("low"), forced("b.high", "high").alias("high"))
    return charts.join(out, "level", "left")


def labels(state: DataFrame, limits: DataFrame, bursts: DataFrame, keys: list[str], standards: DataFrame | None = None, chart: str = "chart_id") -> DataFrame:
    """label (with the tier of a steady section), base_label, steady_tier, has_burst of each section."""
    rows = state.join(limits, chart).join(bursts, keys, "left").withColumn("base_label", base_label())
    if standards is not None:
        rows = rows.join(standards.select(chart, "p33", "p67", "low", "high"), chart, "left")
        mean = F.col("mean")
        tier = F.when(F.col("low") == "all", "LOW").when(F.col("high") == "all", "HIGH").when(F.col("p33").isNull() | F.col("p67").isNull(), None).when(mean <= F.col("p33"), "LOW").when(mean >= F.col("p67"), "HIGH").otherwise("MID")
    else:
        tier = F.lit(None).cast("string")
    rows = rows.withColumn("steady_tier", F.when(F.col("base_label") == "STEADY", tier))
    lift = F.col("burst_density") - F.col("mean")
    active = (F.col("measure_count") > F.greatest(F.col("window_size"), F.lit(1))) & (F.col("burst_density") >= F.col("high_min")) & (lift >= F.col("burst_lift")) & (stats.per_second("burst_density", "mean") >= F.col("burst_ratio"))
    return rows.select(*keys, F.when(F.col("steady_tier").isNotNull(), F.concat("steady_tier", F.lit("_STEADY"))).otherwise(F.col("base_label")).alias("label"), "base_label", "steady_tier", F.coalesce(active, F.lit(False)).alias("has_burst"), "mean", "net_change", "cv", "sign_change_ratio")


def label_counts(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections by label (UNKNOWN without one) and steady sections by tier."""
    return labelled.groupBy(F.coalesce("label", F.lit("UNKNOWN")).alias("label")).count(), labelled.where("steady_tier is not null").groupBy("steady_tier").count()
