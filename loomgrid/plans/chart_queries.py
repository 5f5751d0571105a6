"""Queries of density, sequence, scoring and segment operators over the event charts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import regrid, stats
from ..operators import charts as chart_ops
from ..operators import chunks, density, embedding, scoring, segments
from . import fixtures
from .fixtures import sql
from .lineage import cut

ALL = "notes measures moments burst profile hand triple features base"


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def peak_burst_score(spark, sf_dir):
    b = density.burst(fixtures.measures(spark, sf_dir), ["chart_id"])
    top = b.agg(F.percentile("burst_density", F.lit(0.98)).alias("p98"))
    out = b.crossJoin(F.broadcast(top)).withColumn("peak_score", stats.burst_score("burst_density", "p98"))
    return rounded(out.select("chart_id", "burst_density", "burst_note_count", "start_measure", "end_measure", "peak_score"), "burst_density", "peak_score")


def note_mix(spark, sf_dir):
    m = fixtures.measures(spark, sf_dir).groupBy("chart_id").agg(*(F.sum(c).alias(c) for c in ("tap", "hold", "slide", "touch", "touch_hold")))
    return rounded(density.note_mix(m).select("chart_id", "total", "hold_count", "tap_ratio", "slide_ratio", "hold_ratio", "touch_ratio"), "tap_ratio", "slide_ratio", "hold_ratio", "touch_ratio")


def button_distribution(spark, sf_dir):
    n = fixtures.notes(spark, sf_dir).groupBy("chart_id").agg(*(F.count_if(F.col("lane") == i).alias(f"button_{i}") for i in range(1, 9)))
    names = ("button_variance", "button_stdev", "button_cv", "button_variance_ratio")
    return density.button_distribution(n).select("chart_id", "button_mean", "button_min", "button_max", *(F.round(c, 9).alias(c) for c in names))


def measure_density(spark, sf_dir):
    return rounded(fixtures.measures(spark, sf_dir).select("chart_id", "idx", "density_weight", "non_touch_density_weight", "density", "non_touch_density"), "density", "non_touch_density")


def range_density(spark, sf_dir):
    return rounded(density.range_density(density.in_range(fixtures.measures(spark, sf_dir), 3, 9), ["chart_id"]), "duration_seconds", "density")


def handtrip_distance(spark, sf_dir):
    m = density.movement(density.moments_of(fixtures.measures(spark, sf_dir), ["chart_id"], "hand"), ["chart_id"], twelfths=True)
    return m.select("chart_id", "moment_count", "pair_count", "total_distance", "max_pair_distance")


def slide_distance(spark, sf_dir):
    return density.slide_movement(fixtures.measures(spark, sf_dir), ["chart_id"])


def triple_tap_window(spark, sf_dir):
    t = density.shortest_triple(density.moments_of(fixtures.measures(spark, sf_dir), ["chart_id"], "taps"), ["chart_id"])
    return rounded(t.select("chart_id", "shortest_time_seconds", "window_count", "deduplicated_count"), "shortest_time_seconds")


def boundary_change_scores(spark, sf_dir):
    return rounded(density.boundary_scores(fixtures.measures(spark, sf_dir)), "score")


def smoothed_density(spark, sf_dir):
    return rounded(density.smoothed(fixtures.measures(spark, sf_dir), ["chart_id"], "density").select("chart_id", "idx", "smooth"), "smooth")


def linear_slope(spark, sf_dir):
    return rounded(density.slope(fixtures.measures(spark, sf_dir), ["chart_id"], "density"), "slope")


def raw_features(spark, sf_dir):
    f = scoring.summarize(fixtures.measures(spark, sf_dir), ["chart_id"])
    names = ["density_note_mean", "density_peak_q90", "density_cv", "burst_density", "slide_ratio", "slide_density", "charge_ratio", "charge_density", "handtrip_density", "tricky_shortest_time", "duration_seconds"]
    return rounded(f.select("chart_id", "measure_count", "total_notes", "charge_count", "weighted_sum", *names), *names)


def global_baselines(spark, sf_dir):
    b = scoring.baselines(scoring.summarize(fixtures.measures(spark, sf_dir), ["chart_id"]))
    return rounded(b, *scoring.BASELINES)


def six_dim_scores(spark, sf_dir):
    f = scoring.summarize(fixtures.measures(spark, sf_dir), ["chart_id"])
    names = [f"{n}_score" for n in stats.SCORES]
    return rounded(scoring.scores(f, scoring.baselines(f)).select("chart_id", *names, "dominant_dimension"), *names)


def segment_rows(spark, sf_dir):
    f = scoring.profile(fixtures.sections(spark, sf_dir), ["chart_id", "segment_id"])
    names = ["duration_seconds", "density", "mean_measure_density", "max_measure_density", "min_measure_density", "density_note_mean", "density_peak_q90", "slide_ratio", "charge_density"]
    return rounded(f.select("chart_id", "segment_id", "start_measure", "end_measure", "measure_count", "weighted_sum", *names), *names)


def relative_scores(spark, sf_dir):
    f = scoring.relative_scores(scoring.summarize(fixtures.sections(spark, sf_dir), ["chart_id", "segment_id"]))
    names = [f"{n}_score" for n in stats.SCORES]
    return rounded(f.select("chart_id", "segment_id", *names), *names)


def density_thresholds(spark, sf_dir):
    t = segments.thresholds(fixtures.measures(spark, sf_dir))
    return rounded(t, *(c for c in t.columns if c != "chart_id"))


def density_state_labels(spark, sf_dir):
    m = fixtures.sections(spark, sf_dir)
    keys = ["chart_id", "segment_id"]
    limits = segments.thresholds(m)
    sizes = m.groupBy(*keys).agg(F.count("*").alias("measure_count"))
    bursts = density.burst(m, keys).select(*keys, "burst_density", "window_size").join(sizes, keys)
    out = segments.labels(segments.states(m, limits, keys), limits, bursts, keys)
    return rounded(out.select(*keys, "label", "has_burst", "mean", "net_change", "cv", "sign_change_ratio"), "mean", "net_change", "cv", "sign_change_ratio")


def nearest_standard(spark, sf_dir):
    p = fixtures.table(spark, sf_dir, "part")
    plus = F.when(F.col("p_partkey") % 3 == 0, "+").otherwise("")
    level = F.concat((F.col("p_size") % 18 + 1).cast("string"), plus)
    c = p.select(F.col("p_partkey").alias("chart_id"), F.when(F.col("p_partkey") % 97 == 0, "x").otherwise(level).alias("level"))
    none = "CAST(NULL AS STRING)"
    s = spark.sql(f"SELECT * FROM VALUES (1, '11', 3.0D, 5.0D, {none}, {none}), (2, '12+', 4.0D, 6.0D, {none}, {none}), (3, '13', 5.0D, 7.0D, {none}, {none}), (4, '14', 6.0D, 8.0D, {none}, {none}) AS t(pos, level, p33, p67, low, high)")
    return segments.nearest_standard(c, s).select("chart_id", "level", "source", "standard_level", "p33", "p67", "low", "high")


def segment_dp(spark, sf_dir):
    return rounded(segments.segmentation(fixtures.measures(spark, sf_dir), segments.Config(edge=1)), "score", "boundary_score", "imbalance")


def _sections_of_parts(spark, sf_dir):
    """Five sections of charts of p_size * 3 + 2 measures."""
    p = fixtures.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("chart_id"), (F.col("p_size") * 3 + 2).cast("int").alias("measure_count"))
    rows = p.withColumn("segment_id", F.explode(F.sequence(F.lit(0), F.lit(4))))
    n, k = F.col("measure_count"), F.col("segment_id")
    return rows.withColumns({"start_measure": (F.floor(n * k / 5) + 1).cast("int"), "end_measure": F.floor(n * (k + 1) / 5).cast("int")})


def chunk_ranges(spark, sf_dir):
    return chunks.chunks(_sections_of_parts(spark, sf_dir)).select("chart_id", "segment_id", "start_measure", "end_measure", "body_start_measure", "body_end_measure")


def chart_index_collect(spark, sf_dir):
    c = chunks.chunks(_sections_of_parts(spark, sf_dir))
    names = c.select("chart_id").distinct().withColumn("chart_name", F.concat(F.lit("c"), "chart_id"))
    out = chunks.index(chunks.keyed(c, names))
    return out.select("chart_id", "chunk_count", "segment_count", "first_chunk_key", "last_chunk_key", F.to_json("chunk_ranges").alias("ranges"))


def parse_note_counts(spark, sf_dir):
    good, _ = chart_ops.split_errors(chart_ops.notes(fixtures.charts(spark, sf_dir)))
    c = chart_ops.note_counts(good)
    return c.select(F.col("chart_id").cast("bigint").alias("chart_id"), *(F.col(x).cast("bigint").alias(x) for x in ("tap", "hold", "slide", "touch", "touch_hold", "button_3", "slide_start_taps", "density_weight")))


def parse_slots(spark, sf_dir):
    good, _ = chart_ops.split_errors(chart_ops.slots(fixtures.charts(spark, sf_dir)))
    return rounded(good.select(F.col("chart_id").cast("bigint").alias("chart_id"), F.col("slot").cast("bigint").alias("slot"), "notes", "start_seconds", "beats"), "start_seconds")


def measure_cut(spark, sf_dir):
    good, _ = chart_ops.split_errors(chart_ops.measures(fixtures.charts(spark, sf_dir)))
    return rounded(good.select(F.col("chart_id").cast("bigint").alias("chart_id"), F.col("idx").cast("bigint").alias("idx"), "start_seconds", "end_seconds", "beats", "ended_by", "density_weight"), "start_seconds", "end_seconds", "beats")


def slide_paths(spark, sf_dir):
    good, _ = chart_ops.split_errors(chart_ops.notes(fixtures.charts(spark, sf_dir)))
    rows = good.where("kind = 'slide'").select(F.col("chart_id").cast("bigint").alias("chart_id"), F.explode("paths").alias("path"))
    return rows.groupBy("chart_id", F.get("path", F.lit(0)).cast("bigint").alias("first_lane"), F.element_at("path", -1).cast("bigint").alias("last_lane")).agg(F.count("*").alias("n"))


def divider_normalize(spark, sf_dir):
    p = fixtures.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("chart_id"), "p_size")
    content = F.concat(F.lit("(120){"), (F.pmod(F.col("p_size") * 37, F.lit(700)) + 385).cast("string"), F.lit("}1"), F.repeat(F.lit(","), F.col("p_size") * 5), F.lit("2,{4}3,E"))
    return chart_ops.remarks(p.withColumn("content", content)).where("error is null").select("chart_id", "remark")


def running_timeline(spark, sf_dir):
    n = fixtures.notes(spark, sf_dir)
    slots = n.select("chart_id", F.col("event_id").alias("ord"), F.when((F.col("event_type") == "click") | (F.row_number().over(Window.partitionBy("chart_id").orderBy("event_id")) == 1), F.col("bpm") + F.col("lane")).alias("bpm"), F.when(F.col("event_type") == "view", (F.col("lane") * 4).cast("double")).alias("divider"))
    t = density.timeline(slots, ["chart_id"])
    return rounded(t.select("chart_id", "ord", "bpm", "divider", "start_seconds", "start_beat"), "start_seconds", "start_beat")


def ring_features(spark, sf_dir):
    n = fixtures.notes(spark, sf_dir).where("event_type <> 'error'").select("chart_id", F.col("event_id").alias("ord"), "lane", F.when(F.col("event_type") == "view", 0.5).otherwise(1.0).alias("weight"))
    return rounded(density.transitions(n, ["chart_id"]), "value")


def d8_pooling(spark, sf_dir):
    n = fixtures.notes(spark, sf_dir).crossJoin(F.broadcast(embedding.symmetries(spark)))
    rows = n.select("chart_id", "turn", F.concat(F.lit("lane_"), embedding.turned("lane"), F.lit("_"), "event_type").alias("feature"), F.lit(1.0).alias("value"))
    return rounded(embedding.pool(rows, ["chart_id"]), "mean", "most")


def segmentation_reports(spark, sf_dir):
    """Charts from their text: compiled, cut, labelled and scored; the whole chain in one plan."""
    m, _ = chart_ops.split_errors(chart_ops.measures(fixtures.charts(spark, sf_dir)))
    m = cut(density.with_densities(m), "measures")  # read for the cuts, the labels, the scores and their baselines
    seg = segments.segmentation(m, segments.Config(edge=1))
    rows = cut(segments.assign(m, seg), "sections")
    keys = ["chart_id", "segment_id"]
    limits = segments.thresholds(m)
    feats = scoring.summarize(rows, keys)
    base = scoring.baselines(scoring.summarize(m, ["chart_id"]))
    scored = scoring.scores(feats, base)
    label = segments.labels(segments.states(rows, limits, keys), limits, feats.select(*keys, "burst_density", "window_size", "measure_count"), keys)
    names = [f"{n}_score" for n in stats.SCORES]
    return rounded(scored.join(label.select(*keys, "label", "has_burst"), keys).select(*keys, "start_measure", "end_measure", "label", "has_burst", *names), *names)


def pattern_vectors(spark, sf_dir):
    """Vectors of all windows of all charts."""
    m, _ = chart_ops.split_errors(chart_ops.measures(fixtures.charts(spark, sf_dir)))
    m = cut(m.select("chart_id", "idx", "text", "bpm", "beats", "duration_seconds"), "measures")
    n = m.groupBy("chart_id").agg(F.max("idx").alias("measure_count"))
    rows = n.withColumn("segment_id", F.lit(0)).withColumns({"start_measure": F.lit(1), "end_measure": F.col("measure_count")})
    c = chunks.keyed(chunks.chunks(rows), n.select("chart_id", F.concat(F.lit("c"), "chart_id").alias("chart_name")))
    # a few windows a task: their vectors are the work, not their bytes
    windows = embedding.window_measures(c, m).repartition(4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = embedding.embed(windows)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return out.select("key", F.size("vector").cast("bigint").alias("dimensions"), F.round(length, 4).alias("length"), F.col("event_count").cast("bigint").alias("event_count"), F.round("rhythm_bpm", 6).alias("rhythm_bpm"), "error")


NEEDED = "notes measures"
SQL = {
    "peak_burst_score": sql(
        "notes measures burst",
        """, p AS (SELECT quantile_cont(burst_density, 0.98) AS p98 FROM burst)
SELECT chart_id, round(burst_density, 6) AS burst_density, burst_note_count, start_measure, end_measure,
       round(greatest(0, least(200, 10 + 190 * pow(CASE WHEN p98 > 0 THEN least(1, burst_density / p98) ELSE 0 END, 1.35))), 6) AS peak_score
FROM burst, p""",
    ),
    "note_mix": sql(
        NEEDED,
        """, s AS (SELECT chart_id, sum(tap) AS tap, sum(hold) AS hold, sum(slide) AS slide, sum(touch) AS touch, sum(touch_hold) AS touch_hold FROM measures GROUP BY 1),
t AS (SELECT *, tap + hold + slide + touch + touch_hold AS total FROM s)
SELECT chart_id, total, hold + touch_hold AS hold_count, round(tap / total, 6) AS tap_ratio, round(slide / total, 6) AS slide_ratio, round((hold + touch_hold) / total, 6) AS hold_ratio, round(touch / total, 6) AS touch_ratio FROM t""",
    ),
    "button_distribution": sql(
        "notes",
        """, c AS (SELECT u.chart_id, l.lane, count(n.event_id) AS n FROM (SELECT DISTINCT chart_id FROM notes) u CROSS JOIN range(1, 9) l(lane) LEFT JOIN notes n ON n.chart_id = u.chart_id AND n.lane = l.lane GROUP BY 1, 2)
SELECT chart_id, avg(n) AS button_mean, min(n)::DOUBLE AS button_min, max(n)::DOUBLE AS button_max, round(var_pop(n), 9) AS button_variance, round(stddev_pop(n), 9) AS button_stdev,
       round(stddev_pop(n) / avg(n), 9) AS button_cv, round(var_pop(n) / (avg(n) * avg(n)), 9) AS button_variance_ratio FROM c GROUP BY 1""",
    ),
    "measure_density": sql(NEEDED, "SELECT chart_id, idx, density_weight, non_touch_density_weight, round(density, 6) AS density, round(non_touch_density, 6) AS non_touch_density FROM measures"),
    "range_density": sql(
        NEEDED,
        """SELECT chart_id, min(idx) AS start_measure, max(idx) AS end_measure, count(*) AS measure_count, sum(density_weight) AS weighted_sum, round(sum(duration_seconds), 6) AS duration_seconds, round(sum(density_weight) / sum(duration_seconds), 6) AS density
FROM measures WHERE idx BETWEEN 3 AND 9 GROUP BY 1""",
    ),
    "handtrip_distance": sql("notes measures moments hand", "SELECT chart_id, moment_count, pair_count, hand_distance::DOUBLE AS total_distance, max_distance::DOUBLE AS max_pair_distance FROM hand"),
    "slide_distance": sql(NEEDED, "SELECT chart_id, sum(slide) AS path_count, sum(slide) * 4.0::DOUBLE AS total_distance, CASE WHEN sum(slide) > 0 THEN 4.0::DOUBLE ELSE 0 END AS max_path_distance FROM measures GROUP BY 1"),
    "triple_tap_window": sql("notes measures moments triple", "SELECT chart_id, round(shortest, 6) AS shortest_time_seconds, window_count, deduplicated_count FROM triple"),
    "boundary_change_scores": sql(
        NEEDED,
        """, f AS (
  SELECT chart_id, row_number() OVER w - 1 AS boundary, avg(density) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS l, avg(density) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS r,
         avg(density) OVER (w ROWS BETWEEN 8 PRECEDING AND 5 PRECEDING) AS bf, avg(density) OVER (w ROWS BETWEEN 4 FOLLOWING AND 7 FOLLOWING) AS af,
         avg(density) OVER (w ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS fl, avg(density) OVER (w ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS fr,
         avg(density) OVER (PARTITION BY chart_id) AS m, stddev_pop(density) OVER (PARTITION BY chart_id) AS sd
  FROM measures WINDOW w AS (PARTITION BY chart_id ORDER BY idx)),
g AS (SELECT *, coalesce(r, 0) - coalesce(l, 0) AS step, abs(coalesce(fr, 0) - coalesce(fl, 0)) AS broad FROM f WHERE boundary > 0)
SELECT chart_id, boundary, round(abs(step) + 0.35 * abs(step - (coalesce(af, 0) - coalesce(bf, 0))) + 0.45 * broad
  + CASE WHEN fl <= m - 0.35 * sd AND r > fl THEN 0.9 * (r - fl) + 0.35 * greatest(0, m - fl) ELSE 0 END
  + CASE WHEN step > 0 AND l - bf >= -0.25 AND af - r >= -0.25 THEN 0.55 * step + 0.25 * broad ELSE 0 END, 6) AS score FROM g""",
    ),
    "smoothed_density": sql(
        NEEDED,
        "SELECT chart_id, idx, round(CASE WHEN count(*) OVER (PARTITION BY chart_id) < 3 THEN density ELSE avg(density) OVER (PARTITION BY chart_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END, 6) AS smooth FROM measures",
    ),
    "linear_slope": sql(NEEDED, "SELECT chart_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(density, idx) END, 6) AS slope FROM measures GROUP BY 1"),
    "raw_features": sql(
        ALL,
        """SELECT chart_id, measure_count, total_notes, charge_count, weighted_sum, round(density_note_mean, 6) AS density_note_mean, round(density_peak_q90, 6) AS density_peak_q90, round(density_cv, 6) AS density_cv,
  round(burst_density, 6) AS burst_density, round(slide_ratio, 6) AS slide_ratio, round(slide_density, 6) AS slide_density, round(charge_ratio, 6) AS charge_ratio, round(charge_density, 6) AS charge_density,
  round(handtrip_density, 6) AS handtrip_density, round(tricky_shortest_time, 6) AS tricky_shortest_time, round(duration_seconds, 6) AS duration_seconds FROM features""",
    ),
    "global_baselines": sql(ALL, "SELECT chart_count, " + ", ".join(f"round({c}, 6) AS {c}" for c in scoring.BASELINES) + " FROM base"),
}


def _curve(base: str) -> str:
    """The tricky curve of a base score, in the basis of cubic Hermite polynomials."""
    h = lambda t, y0, y1, s0, s1: f"((2*pow({t},3)-3*pow({t},2)+1)*{y0} + (pow({t},3)-2*pow({t},2)+{t})*{s0} + (3*pow({t},2)-2*pow({t},3))*{y1} + (pow({t},3)-pow({t},2))*{s1})"
    x = f"greatest(0, least(1, {base} / 200.0))"
    left, right = h(f"({x}/0.5)", "0.0", "0.42", "0.675", "0.1"), h(f"(({x}-0.5)/0.5)", "0.42", "1.0", "0.1", "0.875")
    return f"200 * CASE WHEN {x} <= 0.5 THEN greatest(0, least(1, {left})) ELSE greatest(0, least(1, {right})) END"


def _fused(r: str, d: str, r98: str, d98: str) -> str:
    x, y = f"CASE WHEN {r98} > 0 THEN least(1, {r} / {r98}) ELSE 1 END", f"CASE WHEN {d98} > 0 THEN least(1, {d} / {d98}) ELSE 1 END"
    return f"CASE WHEN {r} > 0 AND {d} > 0 THEN 200 * greatest(0, least(1, 1.001::DOUBLE * ({x}) * ({y}) / (0.65 * ({x}) + 0.35 * ({y}) + 0.001))) ELSE 0 END"


def _scores(p: dict[str, str]) -> dict[str, str]:
    cv = f"CASE WHEN abs({p['cv95']} - {p['cv05']}) <= 1e-9 * greatest(abs({p['cv95']}), abs({p['cv05']})) THEN CASE WHEN density_cv > 0 THEN 0.5 ELSE 0 END ELSE greatest(0, least(1, (density_cv - {p['cv05']}) / ({p['cv95']} - {p['cv05']}))) END"
    share = lambda v, hi: f"CASE WHEN {hi} > 0 THEN greatest(0, least(1, {v} / {hi})) ELSE 0 END"
    fast = f"CASE WHEN tricky_shortest_time IS NULL THEN 0.2 WHEN tricky_shortest_time <= 0 OR {p['fast']} <= 0 THEN 200 ELSE 200 * least(1, 1 / tricky_shortest_time / {p['fast']}) END"
    return {
        "note": f"200 * greatest(0, least(1, pow({share('density_note_mean', p['mean'])}, 1.65) * (1 + 0.35 * (({cv}) - 0.5)) / 1.175))",
        "peak": f"greatest(0, least(200, 10 + 190 * pow({share('burst_density', p['burst'])}, 1.35)))",
        "charge": _fused("charge_ratio", "charge_density", p["cr"], p["cd"]),
        "slide": _fused("slide_ratio", "slide_density", p["sr"], p["sd"]),
        "handtrip": f"200 * pow({share('handtrip_density', p['hand'])}, 1.7)",
        "tricky": _curve(f"({fast})"),
    }


_GLOBAL = {"mean": "density_note_mean_p95", "cv05": "density_cv_p05", "cv95": "density_cv_p95", "burst": "burst_density_p98", "cr": "charge_ratio_p98", "cd": "charge_density_p98", "sr": "slide_ratio_p98", "sd": "slide_density_p98", "hand": "handtrip_density_p98", "fast": "tricky_intensity_p98"}
_order = " ".join(f"WHEN {n}_score >= greatest({', '.join(f'{m}_score' for m in stats.SCORES)}) THEN '{n}'" for n in stats.SCORES)
SQL["six_dim_scores"] = sql(
    ALL,
    ", s AS (SELECT chart_id, " + ", ".join(f"{v} AS {n}_score" for n, v in _scores(_GLOBAL).items()) + " FROM features, base)\nSELECT chart_id, " + ", ".join(f"round({n}_score, 6) AS {n}_score" for n in stats.SCORES) + f", CASE {_order} END AS dominant_dimension FROM s",
)
_SECTIONS = ", sections AS (SELECT *, ntile(5) OVER (PARTITION BY chart_id ORDER BY idx) - 1 AS segment_id FROM measures)"
_LONG = "FILTER (duration_seconds >= 0.4)"
SQL["segment_rows"] = sql(
    NEEDED,
    _SECTIONS
    + f""", s AS (SELECT chart_id, segment_id, min(idx) AS start_measure, max(idx) AS end_measure, count(*) AS measure_count, sum(density_weight) AS weighted_sum, sum(duration_seconds) AS duration_seconds,
  sum(density_weight) / sum(duration_seconds) AS density, coalesce(avg(density) {_LONG}, 0) AS mean_measure_density, coalesce(max(density) {_LONG}, 0) AS max_measure_density, coalesce(min(density) {_LONG}, 0) AS min_measure_density,
  coalesce(avg(non_touch_density) {_LONG}, 0) AS density_note_mean, coalesce(quantile_cont(non_touch_density, 0.9) {_LONG}, 0) AS density_peak_q90, sum(slide) / sum(tap + hold + slide + touch + touch_hold) AS slide_ratio,
  sum(hold + touch_hold) / sum(duration_seconds) AS charge_density FROM sections GROUP BY 1, 2)
SELECT chart_id, segment_id, start_measure, end_measure, measure_count, weighted_sum, """
    + ", ".join(f"round({c}, 6) AS {c}" for c in ("duration_seconds", "density", "mean_measure_density", "max_measure_density", "min_measure_density", "density_note_mean", "density_peak_q90", "slide_ratio", "charge_density"))
    + " FROM s",
)
_THRESHOLDS = """, q AS (
  SELECT chart_id, quantile_cont(density, 0.75) - quantile_cont(density, 0.25) AS iqr, quantile_cont(density, 0.2) AS p20, stddev_pop(density) AS sd,
         coalesce(quantile_cont(density, 0.33) FILTER (density > 0), quantile_cont(density, 0.33)) AS lo, coalesce(quantile_cont(density, 0.67) FILTER (density > 0), quantile_cont(density, 0.67)) AS hi
  FROM measures GROUP BY 1),
limits AS (
  SELECT chart_id, greatest(0.25, least(lo * 0.45, p20)) AS rest_max, greatest(0.25, least(lo * 0.45, p20), lo) AS low_max, greatest(0.25, least(lo * 0.45, p20), hi, lo) AS high_min,
         greatest(0.1, iqr * 0.08) AS flat, greatest(0.5, iqr * 0.35, sd * 0.45) AS trend_min, greatest(0.5, iqr * 0.4, sd * 0.7) AS volatile_sd, 0.35::DOUBLE AS volatile_cv,
         greatest(1, iqr * 0.9, sd * 1.2) AS volatile_range, greatest(0.75, iqr * 0.5, sd * 0.6) AS burst_lift, 1.35::DOUBLE AS burst_ratio FROM q)"""
_LIMITS = ("rest_max", "low_max", "high_min", "flat", "trend_min", "volatile_sd", "volatile_cv", "volatile_range", "burst_lift", "burst_ratio")
SQL["density_thresholds"] = sql(NEEDED, _THRESHOLDS + " SELECT chart_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _LIMITS) + " FROM limits")
SQL["density_state_labels"] = sql(
    NEEDED,
    _SECTIONS
    + _THRESHOLDS
    + """, sm AS (
  SELECT chart_id, segment_id, idx, density, density_weight, duration_seconds, tap + hold AS hits,
         CASE WHEN count(*) OVER (PARTITION BY chart_id, segment_id) < 3 THEN density ELSE avg(density) OVER (PARTITION BY chart_id, segment_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS smooth FROM sections),
st AS (SELECT sm.*, smooth - lag(smooth) OVER (PARTITION BY chart_id, segment_id ORDER BY idx) AS step, l.flat, l.rest_max FROM sm JOIN limits l USING (chart_id)),
sg AS (SELECT *, CASE WHEN step > flat THEN 1 WHEN step < -flat THEN -1 WHEN step IS NOT NULL THEN 0 END AS sign FROM st),
moves AS (SELECT chart_id, segment_id, sign, lag(sign) OVER (PARTITION BY chart_id, segment_id ORDER BY idx) AS before FROM sg WHERE sign <> 0),
turns AS (SELECT chart_id, segment_id, count(*) AS n_moves, count(*) FILTER (before <> sign) AS n_turns FROM moves GROUP BY 1, 2),
a AS (
  SELECT chart_id, segment_id, sum(density * duration_seconds) / sum(duration_seconds) AS mean, stddev_pop(smooth) AS sd, stddev_pop(density) AS raw_sd, max(density) - min(density) AS raw_range, max(smooth) - min(smooth) AS rng,
         arg_max(smooth, idx) - arg_min(smooth, idx) AS net, count(sign) AS n, count(*) FILTER (sign > 0) AS up, count(*) FILTER (sign < 0) AS down, count(*) AS measure_count,
         coalesce(sum(duration_seconds) FILTER (density_weight <= 0 OR density <= rest_max), 0) / sum(duration_seconds) AS rest_ratio FROM sg GROUP BY 1, 2),
fr AS (
  SELECT chart_id, segment_id, idx, sum(hits) OVER f AS c, sum(duration_seconds) OVER f AS s, count(*) OVER f AS w, count(*) OVER (PARTITION BY chart_id, segment_id) AS n_all, min(idx) OVER (PARTITION BY chart_id, segment_id) AS i0
  FROM sm WINDOW f AS (PARTITION BY chart_id, segment_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
b AS (SELECT chart_id, segment_id, max(c / s) AS burst_density, max(w) AS window_size FROM fr WHERE w = 4 OR (n_all < 4 AND idx = i0) GROUP BY 1, 2),
z AS (
  SELECT a.*, b.burst_density, b.window_size, l.* EXCLUDE (chart_id), CASE WHEN mean > 0 THEN sd / mean ELSE 0 END AS cv, CASE WHEN mean > 0 THEN raw_sd / mean ELSE 0 END AS raw_cv,
         CASE WHEN n > 0 THEN up / n ELSE 0 END AS ur, CASE WHEN n > 0 THEN down / n ELSE 0 END AS dr, coalesce(t.n_turns, 0) / greatest(1, coalesce(t.n_moves, 0) - 1) AS sc
  FROM a JOIN b USING (chart_id, segment_id) JOIN limits l USING (chart_id) LEFT JOIN turns t USING (chart_id, segment_id))
SELECT chart_id, segment_id, CASE WHEN mean <= rest_max OR rest_ratio >= 0.65 THEN 'REST'
  WHEN net >= trend_min AND ((ur >= 0.55 AND dr <= 0.3) OR (ur >= dr + 0.15 AND sc <= 0.55)) THEN 'RISING'
  WHEN -net >= trend_min AND ((dr >= 0.55 AND ur <= 0.3) OR (dr >= ur + 0.1 AND sc <= 0.55)) THEN 'FALLING'
  WHEN (sd >= volatile_sd AND cv >= volatile_cv AND (sc >= 0.35 OR rng >= volatile_range)) OR (rng >= volatile_range AND cv >= volatile_cv AND sc >= 0.35) OR (raw_cv >= 0.45 AND raw_range >= volatile_range AND sc >= 0.5) THEN 'VOLATILE'
  ELSE 'STEADY' END AS label,
  measure_count > greatest(window_size, 1) AND burst_density >= high_min AND burst_density - mean >= burst_lift AND CASE WHEN mean > 0 THEN burst_density / mean ELSE 0 END >= burst_ratio AS has_burst,
  round(mean, 6) AS mean, round(net, 6) AS net_change, round(cv, 6) AS cv, round(sc, 6) AS sign_change_ratio FROM z""",
)
SQL["nearest_standard"] = """
WITH c AS (SELECT p_partkey AS chart_id, CASE WHEN p_partkey % 97 = 0 THEN 'x' ELSE (p_size % 18 + 1)::VARCHAR || CASE WHEN p_partkey % 3 = 0 THEN '+' ELSE '' END END AS level FROM part),
v AS (SELECT *, try_cast(replace(level, '+', '') AS DOUBLE) + CASE WHEN level LIKE '%+' THEN 0.5 ELSE 0 END AS x FROM c),
s(pos, s_level, s_value, p33, p67) AS (VALUES (1, '11', 11.0, 3.0::DOUBLE, 5.0::DOUBLE), (2, '12+', 12.5, 4.0::DOUBLE, 6.0::DOUBLE), (3, '13', 13.0, 5.0::DOUBLE, 7.0::DOUBLE), (4, '14', 14.0, 6.0::DOUBLE, 8.0::DOUBLE)),
n AS (SELECT chart_id, level, x, first(s_level ORDER BY (level <> s_level), abs(s_value - x), pos) AS b, first(p33 ORDER BY (level <> s_level), abs(s_value - x), pos) AS p33, first(p67 ORDER BY (level <> s_level), abs(s_value - x), pos) AS p67 FROM v, s GROUP BY 1, 2, 3)
SELECT chart_id, level, CASE WHEN level = b THEN 'exact' WHEN x < 11 THEN 'forced_low' WHEN x >= 15 THEN 'forced_high' WHEN x IS NOT NULL THEN 'nearest' ELSE 'none' END AS source,
  CASE WHEN x >= 11 AND x < 15 THEN b END AS standard_level, CASE WHEN x >= 11 AND x < 15 THEN p33 END AS p33, CASE WHEN x >= 11 AND x < 15 THEN p67 END AS p67,
  CASE WHEN level = b THEN NULL WHEN x < 11 THEN 'all' WHEN x >= 15 THEN 'none' END AS low, CASE WHEN level = b THEN NULL WHEN x < 11 THEN 'none' WHEN x >= 15 THEN 'all' END AS high FROM n"""
_PARTS = """WITH p AS (SELECT p_partkey::VARCHAR AS chart_id, p_size * 3 + 2 AS n FROM part),
s AS (SELECT chart_id, n, k AS segment_id, floor(n * k / 5)::INT + 1 AS a, floor(n * (k + 1) / 5)::INT AS z FROM p, range(5) t(k)),
b AS (
  SELECT chart_id, n, segment_id, z, unnest(CASE WHEN z - a + 1 <= 3 THEN [a] ELSE list_distinct(list_concat([x FOR x IN range(a, z - 1, 3)], [z - 2])) END)::INT AS b0 FROM s WHERE n >= 4),
c AS (SELECT chart_id, segment_id, b0, least(z, b0 + 2) AS b1, greatest(4, least(n, b0 + 3)) AS e, greatest(1, least(n, b0 + 3) - 3) AS s0 FROM b),
k AS (SELECT * FROM c WINDOW w AS (PARTITION BY chart_id ORDER BY segment_id, b0) QUALIFY lead(s0) OVER w IS NULL OR lead(s0) OVER w <> s0 OR lead(e) OVER w <> e)
"""
SQL["chunk_ranges"] = _PARTS + "SELECT chart_id, segment_id, s0 AS start_measure, e AS end_measure, b0 AS body_start_measure, b1 AS body_end_measure FROM k"
SQL["chart_index_collect"] = (
    _PARTS
    + """SELECT chart_id, count(*) AS chunk_count, count(DISTINCT segment_id) AS segment_count, first('c' || chart_id || ':' || s0 || '-' || e ORDER BY segment_id, b0) AS first_chunk_key,
  last('c' || chart_id || ':' || s0 || '-' || e ORDER BY segment_id, b0) AS last_chunk_key, '[' || string_agg('[' || s0 || ',' || e || ']', ',' ORDER BY segment_id, b0) || ']' AS ranges FROM k GROUP BY 1"""
)
SQL["parse_note_counts"] = sql(
    "notes",
    """, k AS (SELECT chart_id, lane, event_type FROM notes)
SELECT chart_id, count(*) FILTER (event_type IN ('click', 'purchase')) AS tap, count(*) FILTER (event_type = 'view') AS hold, count(*) FILTER (event_type = 'purchase') AS slide, count(*) FILTER (event_type = 'signup') AS touch,
  count(*) FILTER (event_type = 'error') AS touch_hold, count(*) FILTER (lane = 3 AND event_type IN ('click', 'view', 'purchase')) AS button_3, count(*) FILTER (event_type = 'purchase') AS slide_start_taps,
  sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 1 ELSE 2 END) AS density_weight FROM k GROUP BY 1""",
)
_BOUNDARIES = SQL["boundary_change_scores"].replace("\nSELECT chart_id, boundary, round(abs(step)", ",\nbs AS (SELECT chart_id, boundary, (abs(step)").replace(", 6) AS score FROM g", ") AS score FROM g)")
# all four cuts of a chart: for each last one the largest sum of scores, of those the best after the balance penalty
SQL["segment_dp"] = (
    _BOUNDARIES
    + """,
cfg AS (SELECT chart_id, count(*) AS n, min(idx) AS i0, greatest(1, least(count(*) // 10, 10)) AS lo, greatest(1, least(count(*) // 10, 10), ceil(count(*) / 5 * 1.75)::INT) AS hi FROM measures GROUP BY 1),
b AS (SELECT s.chart_id, s.boundary AS b, score FROM bs s JOIN cfg c ON c.chart_id = s.chart_id WHERE s.boundary BETWEEN greatest(2, lo) AND least(n - 2, n - lo)),
q AS (
  SELECT c.*, a.b AS b1, d.b AS b2, e.b AS b3, f.b AS b4, a.score + d.score + e.score + f.score AS total FROM cfg c
  JOIN b a ON a.chart_id = c.chart_id AND a.b BETWEEN lo AND hi AND n - a.b >= 3 * lo JOIN b d ON d.chart_id = c.chart_id AND d.b - a.b BETWEEN lo AND hi AND n - d.b >= 2 * lo
  JOIN b e ON e.chart_id = c.chart_id AND e.b - d.b BETWEEN lo AND hi AND n - e.b >= lo JOIN b f ON f.chart_id = c.chart_id AND f.b - e.b BETWEEN lo AND hi AND n - f.b <= hi),
t AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY chart_id, b4 ORDER BY total DESC, b3, b2, b1) = 1),
v AS (SELECT *, (abs(b1 - n / 5) + abs(b2 - b1 - n / 5) + abs(b3 - b2 - n / 5) + abs(b4 - b3 - n / 5) + abs(n - b4 - n / 5)) / (n / 5) / 5 AS off FROM t WHERE b1 > 1 AND b4 < n - 1 AND n - b4 >= lo),
w AS (SELECT *, total - off AS value FROM v QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY total - off DESC, b4) = 1),
edges AS (SELECT *, [0, b1, b2, b3, b4, n] AS e, unnest(range(5)) AS k FROM w)
SELECT chart_id, k::INT AS segment_id, (e[k + 1] + i0)::INT AS start_measure, (e[k + 2] + i0 - 1)::INT AS end_measure, round(value, 6) AS score, round(total / 4, 6) AS boundary_score, round(off, 6) AS imbalance FROM edges"""
)


def _rules() -> str:
    """The rules of large dividers as rows: order, divider, shortest and longest run, divider it stands for, grid, name."""
    rows = [(i, d, lo, hi, to, grid, regrid.rule_for(float(d), lo)[2]) for i, (d, ranges, to, grid) in enumerate(regrid.RUN_RULES) for lo, hi in ranges]
    rows += [(len(rows), d, 0, 10**9, to, grid, regrid.rule_for(float(d), 0)[2]) for d, (to, grid) in regrid.RULES.items()]
    return ", ".join(f"({i}, {d}, {lo}, {hi}, {to}, {grid}, '{name}')" for i, d, lo, hi, to, grid, name in rows)


# the chosen grid: the rule's if its error is within 1/96 of a beat, else the first finer one that is (384 always is); errors as fractions of whole numbers
SQL["divider_normalize"] = f"""WITH r(i, d, lo, hi, s, g, name) AS (VALUES {_rules()}),
p AS (SELECT p_partkey::VARCHAR AS chart_id, (p_size * 37) % 700 + 385 AS d, p_size * 5 + 1 AS l FROM part),
m AS (SELECT p.*, r.s, r.g, r.name FROM p LEFT JOIN r ON r.d = p.d AND p.l BETWEEN r.lo AND r.hi QUALIFY row_number() OVER (PARTITION BY p.chart_id ORDER BY r.i) = 1),
c AS (SELECT m.*, gg, (2 * l * gg + s) // (2 * s) AS n FROM m, (VALUES {', '.join(f'({g})' for g in regrid.GRIDS)}) x(gg) WHERE gg >= g),
ok AS (SELECT chart_id, min(gg) AS grid FROM c WHERE 384 * abs(n * s - l * gg) <= gg * s AND n > 0 GROUP BY 1),
plain AS (SELECT chart_id, (l * 32) % d = 0 AND ((l - 1) * 32) % d = 0 AS whole FROM m WHERE name IS NULL)
SELECT chart_id, 'converted 1 large divider run(s) to {{' || grid || '}}' AS remark FROM ok
UNION ALL SELECT chart_id, 'treated 1 large divider run(s) with ' || name || ' before converting' FROM m WHERE name IS NOT NULL
UNION ALL SELECT chart_id, CASE WHEN whole THEN 'converted 1 large divider run(s) to {{32}}' ELSE 'kept 1 large divider run(s) because they do not align to normalized grids' END FROM plain"""
_SLOTS = """WITH k AS (
  SELECT user_id AS chart_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS slot, event_id % 8 + 1 AS lane, (event_id % 8 + 4) % 8 + 1 AS dest, event_type FROM events)
"""
_TOKEN = "CASE event_type WHEN 'click' THEN lane::VARCHAR WHEN 'view' THEN lane || 'h[4:1]' WHEN 'purchase' THEN lane || '-' || dest || '[8:1]' WHEN 'signup' THEN 'A' || lane ELSE 'B' || lane || 'h[8:3]' END"
SQL["parse_slots"] = _SLOTS + f"SELECT chart_id, slot, {_TOKEN} AS notes, round((slot - 1) * 0.5::DOUBLE, 6) AS start_seconds, 1.0::DOUBLE AS beats FROM k"
SQL["measure_cut"] = (
    _SLOTS
    + """SELECT chart_id, (slot - 1) // 4 + 1 AS idx, round(((slot - 1) // 4) * 2.0::DOUBLE, 6) AS start_seconds, round(((slot - 1) // 4) * 2.0::DOUBLE + count(*) * 0.5::DOUBLE, 6) AS end_seconds, count(*)::DOUBLE AS beats,
  CASE WHEN count(*) = 4 THEN 'measure_full' ELSE 'chart_end' END AS ended_by, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 1 ELSE 2 END) AS density_weight
FROM k GROUP BY chart_id, (slot - 1) // 4"""
)
SQL["slide_paths"] = _SLOTS + "SELECT chart_id, lane AS first_lane, dest AS last_lane, count(*) AS n FROM k WHERE event_type = 'purchase' GROUP BY 1, 2, 3"
SQL["running_timeline"] = sql(
    "notes",
    """, x AS (SELECT chart_id, event_id AS ord, CASE WHEN event_type = 'click' OR row_number() OVER (PARTITION BY chart_id ORDER BY event_id) = 1 THEN bpm + lane END AS b, CASE WHEN event_type = 'view' THEN (lane * 4)::DOUBLE END AS d FROM notes),
y AS (SELECT chart_id, ord, last_value(b IGNORE NULLS) OVER w AS bpm, coalesce(last_value(d IGNORE NULLS) OVER w, 4.0) AS divider FROM x WINDOW w AS (PARTITION BY chart_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT chart_id, ord, bpm, divider, round(coalesce(sum(240.0 / bpm / divider) OVER p, 0), 6) AS start_seconds, round(coalesce(sum(4.0 / divider) OVER p, 0), 6) AS start_beat
FROM y WINDOW p AS (PARTITION BY chart_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
SQL["ring_features"] = sql(
    "notes",
    """, x AS (
  SELECT chart_id, lane AS b, lag(lane) OVER w AS a, least(CASE WHEN event_type = 'view' THEN 0.5 ELSE 1.0 END, lag(CASE WHEN event_type = 'view' THEN 0.5 ELSE 1.0 END) OVER w)::DOUBLE AS v
  FROM notes WHERE event_type <> 'error' WINDOW w AS (PARTITION BY chart_id ORDER BY event_id)),
y AS (SELECT *, (b - a + 8) % 8 AS cw FROM x WHERE a IS NOT NULL),
z AS (SELECT chart_id, v, unnest(['distance_' || least(cw, 8 - cw), 'direction_' || CASE WHEN cw = 0 THEN 'same' WHEN cw = 4 THEN 'opposite' WHEN cw < 4 THEN 'cw' ELSE 'ccw' END, 'step_' || cw, 'pair_' || a || '_' || b]) AS feature FROM y)
SELECT chart_id, feature, round(sum(v), 6) AS value FROM z GROUP BY 1, 2""",
)
SQL["d8_pooling"] = sql(
    "notes",
    """, x AS (SELECT chart_id, t.k AS turn, 'lane_' || ((CASE WHEN t.k >= 8 THEN 1 - lane ELSE lane - 1 END + t.k % 8 + 16) % 8 + 1) || '_' || event_type AS feature, count(*)::DOUBLE AS v FROM notes, range(16) t(k) GROUP BY 1, 2, 3)
SELECT chart_id, feature, round(sum(v) / 16, 6) AS mean, round(max(v), 6) AS most FROM x GROUP BY 1, 2""",
)

# sections as charts of their own: their features, then percentiles over the sections of a chart
_OWN = (
    "WITH " + fixtures.CTE["notes"].replace("notes AS", "all_notes AS")
    + """, places AS (SELECT chart_id, idx, ntile(5) OVER (PARTITION BY chart_id ORDER BY idx) - 1 AS g FROM (SELECT DISTINCT chart_id, idx FROM all_notes)),
notes AS (SELECT n.* REPLACE (n.chart_id * 10 + g AS chart_id) FROM all_notes n JOIN places p ON p.chart_id = n.chart_id AND p.idx = n.idx),
""" + ",\n".join(fixtures.CTE[c] for c in fixtures.ORDER[1:-1]).replace("(n_all < 4 AND idx = 1)", "(n_all < 4 AND idx = i0)").replace("count(*) OVER (PARTITION BY chart_id) AS n_all", "count(*) OVER (PARTITION BY chart_id) AS n_all, min(idx) OVER (PARTITION BY chart_id) AS i0")
)
_MARKS = {
    "mean": "quantile_cont(density_note_mean, 0.95) OVER c", "cv05": "quantile_cont(density_cv, 0.05) OVER c", "cv95": "quantile_cont(density_cv, 0.95) OVER c",
    "burst": "coalesce(quantile_cont(burst_density, 0.98) FILTER (burst_density > 0) OVER c, 1)", "hand": "coalesce(nullif(greatest(0, quantile_cont(handtrip_density, 0.98) OVER c), 0), 1)",
    "fast": "coalesce(nullif(quantile_cont(1 / tricky_shortest_time, 0.98) FILTER (tricky_shortest_time > 0) OVER c, 0), 1)",
    "sr": "coalesce(nullif(quantile_cont(slide_ratio, 0.98) OVER c, 0), 0.2)", "sd": "coalesce(nullif(quantile_cont(slide_density, 0.98) OVER c, 0), 1.5)",
    "cr": "coalesce(nullif(quantile_cont(charge_ratio, 0.98) OVER c, 0), 0.2)", "cd": "coalesce(nullif(quantile_cont(charge_density, 0.98) OVER c, 0), 1.5)",
}
SQL["relative_scores"] = (
    _OWN + ", marked AS (SELECT *, " + ", ".join(f"{v} AS p_{k}" for k, v in _MARKS.items()) + " FROM features WINDOW c AS (PARTITION BY chart_id // 10))\nSELECT chart_id // 10 AS chart_id, (chart_id % 10)::INT AS segment_id, "
    + ", ".join(f"round({v}, 6) AS {n}_score" for n, v in _scores({k: f"p_{k}" for k in _MARKS}).items()) + " FROM marked"
)

# the whole chain from chart text: measures of four events, their cuts, the sections' labels, and their scores by the percentiles of the charts
_TEXT_MEASURES = """raw_measures AS (
  SELECT chart_id, idx, count(*) * 0.5::DOUBLE AS duration_seconds, count(*)::DOUBLE AS beats, count(*) FILTER (event_type IN ('click', 'purchase')) AS tap, count(*) FILTER (event_type = 'view') AS hold,
         count(*) FILTER (event_type = 'purchase') AS slide, count(*) FILTER (event_type = 'signup') AS touch, count(*) FILTER (event_type = 'error') AS touch_hold,
         sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END) AS non_touch_density_weight, sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 1 ELSE 2 END) AS density_weight
  FROM notes GROUP BY 1, 2),
measures AS (SELECT *, non_touch_density_weight / duration_seconds AS non_touch_density, density_weight / duration_seconds AS density FROM raw_measures),
starts AS (
  SELECT chart_id, idx, coalesce(sum(duration_seconds) OVER w, 0) AS s0, coalesce(sum(beats) OVER w, 0) AS b0 FROM measures WINDOW w AS (PARTITION BY chart_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
moments AS (SELECT n.*, s0 + pos * 0.5::DOUBLE AS time_seconds, b0 + pos AS beat FROM notes n JOIN starts s ON n.chart_id = s.chart_id AND n.idx = s.idx)"""
_TEXT_FEATURES = (_TEXT_MEASURES + ",\n" + ",\n".join(fixtures.CTE[c] for c in ("burst", "profile", "hand", "triple", "features"))).replace("(n_all < 4 AND idx = 1)", "(n_all < 4 AND idx = i0)").replace(
    "count(*) OVER (PARTITION BY chart_id) AS n_all", "count(*) OVER (PARTITION BY chart_id) AS n_all, min(idx) OVER (PARTITION BY chart_id) AS i0"
)
_cuts = SQL["segment_dp"].split("measures AS (", 1)[1]
_cuts = _cuts[_cuts.index(", f AS (") : _cuts.index("\nSELECT chart_id, k::INT")]
_labels = SQL["density_state_labels"]
_labels = _labels[_labels.index(", sm AS (") :].replace("\nSELECT chart_id, segment_id, CASE WHEN mean", ",\nlabelled AS (SELECT chart_id, segment_id, CASE WHEN mean")
_labels = _labels[: _labels.index(",\n  round(mean, 6)")] + " FROM z)"
SQL["segmentation_reports"] = (
    "WITH k AS (SELECT user_id AS chart_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS slot, event_id % 8 + 1 AS lane, event_type FROM events),\n"
    "all_notes AS (SELECT chart_id, slot // 4 + 1 AS idx, slot % 4 AS pos, slot AS event_id, lane, 120.0::DOUBLE AS bpm, event_type FROM k),\nnotes AS (SELECT * FROM all_notes),\n"
    + _TEXT_FEATURES + ",\n" + fixtures.CTE["base"] + ",\ncut_edges AS (WITH " + _cuts.lstrip(", ") + " SELECT * FROM edges)"
    + ",\nseg AS (SELECT chart_id, k::INT AS segment_id, e[k + 1] + i0 AS start_measure, e[k + 2] + i0 - 1 AS end_measure FROM cut_edges),\n"
    + "sections AS (SELECT m.*, segment_id FROM measures m JOIN seg s ON s.chart_id = m.chart_id AND m.idx BETWEEN start_measure AND end_measure)" + _THRESHOLDS + _labels
    + ",\nsection_features AS (WITH notes AS (SELECT n.* REPLACE (n.chart_id * 10 + segment_id AS chart_id) FROM all_notes n JOIN seg s ON s.chart_id = n.chart_id AND n.idx BETWEEN start_measure AND end_measure),\n" + _TEXT_FEATURES + " SELECT * FROM features)"
    + ",\nscored AS (SELECT chart_id // 10 AS chart_id, (chart_id % 10)::INT AS segment_id, start_measure, end_measure, " + ", ".join(f"{v} AS {n}_score" for n, v in _scores(_GLOBAL).items()) + " FROM section_features, base)"
    + "\nSELECT s.chart_id::VARCHAR AS chart_id, s.segment_id, start_measure, end_measure, label, has_burst, " + ", ".join(f"round({n}_score, 6) AS {n}_score" for n in stats.SCORES) + " FROM scored s JOIN labelled l ON l.chart_id = s.chart_id AND l.segment_id = s.segment_id"
)

SQL["pattern_vectors"] = """WITH p AS (SELECT user_id AS chart_id, ceil(count(*) / 4)::INT AS n, count(*) AS events FROM events GROUP BY 1),
b AS (SELECT chart_id, n, events, unnest(list_distinct(list_concat([x FOR x IN range(1, n - 1, 3)], [n - 2])))::INT AS b0 FROM p WHERE n >= 4),
c AS (SELECT chart_id, n, events, b0, greatest(4, least(n, b0 + 3)) AS e, greatest(1, least(n, b0 + 3) - 3) AS s0 FROM b),
k AS (SELECT * FROM c WINDOW w AS (PARTITION BY chart_id ORDER BY b0) QUALIFY lead(s0) OVER w IS NULL OR lead(s0) OVER w <> s0 OR lead(e) OVER w <> e)
SELECT 'c' || chart_id || ':' || s0 || '-' || e AS key, 4413 AS dimensions, 1.0::DOUBLE AS length, least(events, e * 4) - (s0 - 1) * 4 AS event_count, 120.0::DOUBLE AS rhythm_bpm, NULL::VARCHAR AS error FROM k"""

#: Sums that DuckDB widens are long integers here as well.
for _name, _columns in {
    "peak_burst_score": "burst_note_count", "note_mix": "hold_count total", "range_density": "weighted_sum", "slide_distance": "path_count", "triple_tap_window": "deduplicated_count",
    "raw_features": "charge_count total_notes weighted_sum", "segment_rows": "weighted_sum", "parse_note_counts": "density_weight", "measure_cut": "density_weight",
}.items():
    SQL[_name] = fixtures.long(SQL[_name], _columns)

QUERIES = (
    peak_burst_score, note_mix, button_distribution, measure_density, range_density, handtrip_distance, slide_distance, triple_tap_window, boundary_change_scores, smoothed_density,
    linear_slope, raw_features, global_baselines, six_dim_scores, segment_rows, relative_scores, density_thresholds, density_state_labels, nearest_standard, segment_dp, chunk_ranges,
    chart_index_collect, parse_note_counts, parse_slots, measure_cut, slide_paths, divider_normalize, running_timeline, ring_features, d8_pooling, segmentation_reports, pattern_vectors,
)
