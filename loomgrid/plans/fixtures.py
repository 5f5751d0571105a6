"""The driver's tables seen as charts, for Spark and as SQL.

An event stream is a library of charts: a user is a chart, a day a measure, an event a note whose type
is its kind and whose id gives its lane.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import density


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notes: chart_id, idx of the measure, seconds of the day, lane, kind, seconds of the measure."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    day = F.to_date("ts")
    return e.select(
        F.col("user_id").alias("chart_id"),
        F.dense_rank().over(Window.partitionBy("user_id").orderBy(day)).alias("idx"),
        (0.3 + 0.25 * F.pmod(F.unix_date(day), F.lit(8))).alias("duration_seconds"),
        (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("sod"),
        (F.pmod("event_id", F.lit(8)) + 1).cast("int").alias("lane"),
        (120.0 + 50.0 * F.pmod("user_id", F.lit(3))).alias("bpm"),
        "event_id", "event_type",
    )


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures with counters, weights, densities, moments and slide paths."""
    rows = notes(spark, sf_dir)
    count = lambda kind: F.count_if(F.col("event_type") == kind).cast("bigint")
    lane = F.array("lane")
    none = F.array().cast("array<int>")
    of = lambda *kinds: F.when(F.col("event_type").isin(*kinds), lane).otherwise(none)
    moment = F.struct(
        "sod", "event_id", (F.col("sod") / 86400 * F.col("duration_seconds")).alias("local_seconds"), (F.col("sod") / 86400 * 4).alias("local_beat"), "bpm",
        of("click", "view", "purchase").alias("all"), of("click", "view").alias("hand"), of("click", "purchase").alias("taps"),
    )
    sounding = F.col("event_type").isin("click", "view", "purchase")
    path = F.when(F.col("event_type") == "purchase", F.array(F.col("lane"), F.pmod(F.col("lane") + 3, F.lit(8)) + 1))
    m = rows.groupBy("chart_id", "idx", "duration_seconds").agg(
        count("click").alias("tap"), count("view").alias("hold"), count("purchase").alias("slide"), count("signup").alias("touch"), count("error").alias("touch_hold"),
        F.array_sort(F.collect_list(F.when(sounding, moment))).alias("moments"), F.collect_list(path).alias("paths"),
    )
    held = F.col("tap") + 2 * F.col("hold") + 3 * F.col("slide")
    return density.with_densities(m.withColumns({"beats": F.lit(4.0), "non_touch_density_weight": held, "density_weight": held + F.least(F.lit(3), F.col("touch") + F.col("touch_hold"))}))


def charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart text of every user: one slot for each event, in order."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    lane = (F.pmod("event_id", F.lit(8)) + 1).cast("string")
    to = (F.pmod(F.pmod("event_id", F.lit(8)) + 4, F.lit(8)) + 1).cast("string")
    token = (
        F.when(F.col("event_type") == "click", lane)
        .when(F.col("event_type") == "view", F.concat(lane, F.lit("h[4:1]")))
        .when(F.col("event_type") == "purchase", F.concat(lane, F.lit("-"), to, F.lit("[8:1]")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("A"), lane))
        .otherwise(F.concat(F.lit("B"), lane, F.lit("h[8:3]")))
    )
    slots = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", token.alias("token")))), lambda x: x["token"])
    return e.groupBy(F.col("user_id").alias("chart_id")).agg(F.concat(F.lit("(120){4}"), F.array_join(slots, ","), F.lit(",E")).alias("content"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures with a segment_id: five runs of nearly equal length of each chart."""
    m = measures(spark, sf_dir)
    return m.withColumn("segment_id", F.ntile(5).over(Window.partitionBy("chart_id").orderBy("idx")) - 1)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a vector and the sum of itself and a quarter of the next, as if of two kinds: id, a, b."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    n = e.count()
    other = e.select(F.pmod(F.col("id") - 1 + n, F.lit(n)).alias("id"), F.col("a").alias("_o"))
    return e.join(other, "id").select("id", "a", F.zip_with("a", "_o", lambda x, y: x + y * 0.25).alias("b"))


#: The same projections as common table expressions.
CTE = {
    "notes": """notes AS (
  SELECT user_id AS chart_id, dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS idx,
         0.3::DOUBLE + 0.25::DOUBLE * (date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) % 8) AS duration_seconds,
         hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS sod, event_id % 8 + 1 AS lane,
         120.0::DOUBLE + 50.0::DOUBLE * (user_id % 3) AS bpm, event_id, event_type
  FROM events)""",
    "measures": """raw_measures AS (
  SELECT chart_id, idx, duration_seconds, count(*) FILTER (event_type = 'click') AS tap, count(*) FILTER (event_type = 'view') AS hold,
         count(*) FILTER (event_type = 'purchase') AS slide, count(*) FILTER (event_type = 'signup') AS touch, count(*) FILTER (event_type = 'error') AS touch_hold
  FROM notes GROUP BY ALL),
measures AS (
  SELECT *, tap + 2 * hold + 3 * slide AS non_touch_density_weight, tap + 2 * hold + 3 * slide + least(3, touch + touch_hold) AS density_weight,
         (tap + 2 * hold + 3 * slide) / duration_seconds AS non_touch_density, (tap + 2 * hold + 3 * slide + least(3, touch + touch_hold)) / duration_seconds AS density
  FROM raw_measures)""",
    "moments": """starts AS (
  SELECT chart_id, idx, coalesce(sum(duration_seconds) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0, (row_number() OVER w - 1) * 4.0 AS b0
  FROM measures WINDOW w AS (PARTITION BY chart_id ORDER BY idx)),
moments AS (
  SELECT n.chart_id, n.idx, n.event_id, n.sod, n.lane, n.bpm, n.event_type, s0 + n.sod / 86400 * n.duration_seconds AS time_seconds, b0 + n.sod / 86400 * 4 AS beat
  FROM notes n JOIN starts s ON n.chart_id = s.chart_id AND n.idx = s.idx)""",
    "burst": """frames AS (
  SELECT chart_id, idx, sum(tap + hold) OVER f AS note_count, sum(duration_seconds) OVER f AS burst_seconds, count(*) OVER f AS window_size, max(idx) OVER f AS end_measure,
         count(*) OVER (PARTITION BY chart_id) AS n_all
  FROM measures WINDOW f AS (PARTITION BY chart_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
burst AS (
  SELECT chart_id, note_count / burst_seconds AS burst_density, note_count AS burst_note_count, burst_seconds, window_size, idx AS start_measure, end_measure
  FROM frames WHERE window_size = 4 OR (n_all < 4 AND idx = 1)
  QUALIFY row_number() OVER (PARTITION BY chart_id ORDER BY note_count / burst_seconds DESC, idx) = 1)""",
    "profile": """profile AS (
  SELECT chart_id, min(idx) AS start_measure, max(idx) AS end_measure, count(*) AS measure_count, sum(duration_seconds) AS duration_seconds, sum(density_weight) AS weighted_sum,
         sum(tap) AS tap, sum(hold) AS hold, sum(slide) AS slide, sum(touch) AS touch, sum(touch_hold) AS touch_hold,
         coalesce(avg(non_touch_density) FILTER (duration_seconds >= 0.4), 0) AS density_note_mean,
         coalesce(quantile_cont(non_touch_density, 0.9) FILTER (duration_seconds >= 0.4), 0) AS density_peak_q90,
         coalesce(stddev_pop(non_touch_density) FILTER (duration_seconds >= 0.4), 0) AS density_stdev
  FROM measures GROUP BY chart_id)""",
    "hand": """hand_pairs AS (
  SELECT chart_id, abs(lane - lag(lane) OVER w) AS d, beat - lag(beat) OVER w AS gap, bpm
  FROM moments WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY chart_id ORDER BY time_seconds, beat, idx, event_id)),
hand AS (
  SELECT chart_id, count(*) AS moment_count, count(*) FILTER (gap > CASE WHEN bpm > 200 THEN 1.0::DOUBLE / 3 ELSE 0.25 END) AS pair_count,
         coalesce(sum(least(d, 8 - d)) FILTER (gap > CASE WHEN bpm > 200 THEN 1.0::DOUBLE / 3 ELSE 0.25 END), 0) AS hand_distance,
         coalesce(max(least(d, 8 - d)) FILTER (gap > CASE WHEN bpm > 200 THEN 1.0::DOUBLE / 3 ELSE 0.25 END), 0) AS max_distance
  FROM hand_pairs GROUP BY chart_id)""",
    "triple": """tap_rows AS (
  SELECT chart_id, lane, round(beat, 9) AS beat, min(time_seconds) AS t, count(*) AS n FROM moments WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2, 3),
triple_windows AS (SELECT chart_id, lane, t, n, lead(t, 2) OVER (PARTITION BY chart_id, lane ORDER BY t, beat) AS t_end FROM tap_rows),
triple AS (SELECT chart_id, min(t_end - t) AS shortest, count(t_end) AS window_count, sum(n - 1) AS deduplicated_count FROM triple_windows GROUP BY chart_id)""",
    "features": """features AS (
  SELECT p.*, p.tap + p.hold + p.slide + p.touch + p.touch_hold AS total_notes, p.hold + p.touch_hold AS charge_count,
         CASE WHEN density_note_mean > 0 THEN density_stdev / density_note_mean ELSE 0 END AS density_cv, b.burst_density, b.burst_note_count,
         p.slide / (p.tap + p.hold + p.slide + p.touch + p.touch_hold) AS slide_ratio, (p.hold + p.touch_hold) / (p.tap + p.hold + p.slide + p.touch + p.touch_hold) AS charge_ratio,
         p.slide / p.duration_seconds AS slide_density, (p.hold + p.touch_hold) / p.duration_seconds AS charge_density,
         (coalesce(h.hand_distance, 0) + 4.0::DOUBLE * p.slide) / p.duration_seconds AS handtrip_density, t.shortest AS tricky_shortest_time
  FROM profile p JOIN burst b USING (chart_id) LEFT JOIN hand h USING (chart_id) LEFT JOIN triple t USING (chart_id))""",
    "base": """base AS (
  SELECT count(*) AS chart_count, quantile_cont(density_note_mean, 0.95) AS density_note_mean_p95, quantile_cont(density_peak_q90, 0.95) AS density_peak_q90_p95,
         quantile_cont(density_cv, 0.05) AS density_cv_p05, quantile_cont(density_cv, 0.95) AS density_cv_p95, quantile_cont(burst_density, 0.98) AS burst_density_p98,
         quantile_cont(slide_density, 0.98) AS slide_density_p98, quantile_cont(slide_ratio, 0.98) AS slide_ratio_p98, quantile_cont(charge_density, 0.98) AS charge_density_p98,
         quantile_cont(charge_ratio, 0.98) AS charge_ratio_p98, quantile_cont(handtrip_density, 0.98) AS handtrip_density_p98,
         coalesce(quantile_cont(1 / tricky_shortest_time, 0.98) FILTER (tricky_shortest_time > 0), 1) AS tricky_intensity_p98
  FROM features)""",
}
ORDER = tuple(CTE)


def sql(names: str, query: str) -> str:
    """The query after the named expressions and those they build on (in the order of CTE)."""
    chosen = names.split()
    return "WITH " + ",\n".join(CTE[n] for n in ORDER if n in chosen) + "\n" + query


def long(query: str, columns: str) -> str:
    """The query with columns as BIGINT."""
    return "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns.split()) + f") FROM ({query})"
