"""Queries of the windows' feature vectors, against SQL that derives the same features from the tables.

Two kinds of windows: sixteen events of a user in a row (one note a slot, all kinds of notes), and eight
orders of a customer in a row (a chord of the lanes of their lines in each slot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pattern
from ..operators import charts as chart_ops
from ..operators import chunks, embedding
from . import fixtures
from .fixtures import table

ALL_FEATURES = 100_000
LIKENESS = r"^(soft_shape|path_length)"  # sampled geometry, tested for itself


def event_windows(spark, sf_dir) -> DataFrame:
    """Four whole measures in a row of the event charts, from their text."""
    m, _ = chart_ops.split_errors(chart_ops.measures(fixtures.charts(spark, sf_dir)))
    m = m.where("beats = 4").withColumn("duration_seconds", F.col("duration_seconds") + F.pmod("idx", F.lit(3)) * 0.25)
    return _windows(m.withColumn("win", F.floor((F.col("idx") - 1) / 4)))


def chord_windows(spark, sf_dir) -> DataFrame:
    """Four measures of two chords in a row for each customer."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    lanes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set((F.col("l_partkey") % 8 + 1).cast("int"))).alias("lanes"))
    rows = o.join(lanes, "o_orderkey").withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    item = F.array_sort(F.collect_list(F.struct("i", F.array_join("lanes", "/").alias("chord"))))
    m = rows.groupBy(F.col("o_custkey").alias("chart_id"), F.floor(F.col("i") / 2).alias("idx")).agg(item.alias("slots")).where(F.size("slots") == 2)
    text = F.concat(F.lit("{2}"), F.array_join(F.transform("slots", lambda x: x["chord"]), ","), F.lit(","))
    m = m.select(F.col("chart_id").cast("string").alias("chart_id"), (F.col("idx") + 1).cast("int").alias("idx"), text.alias("text"), F.lit(120.0).alias("bpm"), F.lit(4.0).alias("beats"), F.lit(2.0).alias("duration_seconds"))
    return _windows(m.withColumn("win", F.floor((F.col("idx") - 1) / 4)))


def _windows(measures: DataFrame) -> DataFrame:
    item = F.struct("idx", "text", "bpm", "beats", "duration_seconds")
    rows = measures.groupBy("chart_id", "win").agg(F.array_sort(F.collect_list(item)).alias("measures")).where(F.size("measures") == 4)
    return rows.select(F.concat_ws(":", "chart_id", F.col("win").cast("string")).alias("key"), "measures", F.lit(None).cast("array<int>").alias("overlap_slots"))


def _features(windows: DataFrame, *blocks: str) -> DataFrame:
    """key, block, name and value of the features of some blocks."""
    rows = embedding.embed(windows, features=ALL_FEATURES).select("key", F.explode("top").alias("block", "features")).where(F.col("block").isin(*blocks))
    rows = rows.select("key", "block", F.explode("features").alias("f")).select("key", "block", F.col("f.name").alias("name"), F.col("f.value").alias("value"))
    return rows.where(~F.col("name").rlike(LIKENESS)).withColumn("value", F.round("value", 9))


def top_features(spark, sf_dir):
    """All features of notes, lanes, steps, slides and touches of the event windows."""
    return _features(event_windows(spark, sf_dir), "time", "absolute", "topology", "slide", "touch")


def hand_load(spark, sf_dir):
    """How the hands share the notes of the event windows."""
    return _features(event_windows(spark, sf_dir), "hand_balance")


def rhythm_fft(spark, sf_dir):
    """The whole spectrum of the event windows' onsets, with tempo and onset density."""
    return _features(event_windows(spark, sf_dir), "rhythm_fft").where("abs(value) > 1e-6 and name not like 'bpm%'")


def effective_tempo(spark, sf_dir):
    """Beats, tempo and events of the event windows."""
    out = embedding.embed(event_windows(spark, sf_dir))
    return out.select("key", F.col("event_count").cast("bigint").alias("event_count"), "weighted_event_count", "total_beats", F.round("rhythm_bpm", 6).alias("rhythm_bpm"))


def each_pairs(spark, sf_dir):
    """Steps, chords and hands of the chord windows."""
    return _features(chord_windows(spark, sf_dir), "topology", "hand_balance")


def vector_blocks(spark, sf_dir):
    """The length of each block in the event windows' vectors, and of the whole."""
    rows = embedding.embed(event_windows(spark, sf_dir))
    out, at = {}, 0
    squares = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    for block, names in pattern.schema().items():
        out[block] = F.round(F.sqrt(squares(F.slice("vector", at + 1, len(names)))), 4)
        at += len(names)
    return rows.select("key", F.size("vector").cast("bigint").alias("dimensions"), F.round(F.sqrt(squares(F.col("vector"))), 4).alias("length"), *(v.alias(f"{k}_length") for k, v in out.items()))


def measure_weights(spark, sf_dir):
    """Weights of the four measures of windows, by which of them are outside the body."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("start"))
    p = p.withColumns({"body_start": F.col("start") + F.pmod("p_partkey", F.lit(2)).cast("int"), "body_end": F.col("start") + 2 + F.pmod("p_partkey", F.lit(2)).cast("int")})
    p = p.withColumn("overlap_slots", F.when(F.col("p_partkey") % 5 > 0, chunks.overlap_slots()))
    return p.select("p_partkey", F.array_join(F.transform(chunks.weights(), lambda x: (x * 10).cast("int").cast("string")), ",").alias("tenths"))


QUERIES = (top_features, hand_load, rhythm_fft, effective_tempo, each_pairs, vector_blocks, measure_weights)

_EVENTS = """WITH k AS (
  SELECT user_id AS chart_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS slot, event_id % 8 + 1 AS lane, (event_id % 8 + 4) % 8 + 1 AS dest, event_type FROM events),
w AS (SELECT *, slot // 16 AS win, slot % 16 AS beat FROM k QUALIFY count(*) OVER (PARTITION BY chart_id, slot // 16) = 16),
ev AS (
  SELECT chart_id || ':' || win AS key, win, beat::DOUBLE AS beat, 1 AS ord, 1 AS size, beat // 4 AS m, CASE WHEN beat >= 12 THEN 0.5::DOUBLE ELSE 1 END AS wt, lane, dest,
    CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'hold' WHEN 'purchase' THEN 'slide' WHEN 'signup' THEN 'touch' ELSE 'touch_hold' END AS kind,
    CASE event_type WHEN 'signup' THEN 'A' WHEN 'error' THEN 'B' ELSE '' END AS fam FROM w)"""
_CHORDS = """WITH c AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey % 8 + 1))) AS lanes FROM lineitem GROUP BY 1),
k AS (SELECT o_custkey AS chart_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS slot, lanes FROM orders JOIN c ON l_orderkey = o_orderkey),
w AS (SELECT *, slot // 8 AS win, slot % 8 AS i FROM k QUALIFY count(*) OVER (PARTITION BY chart_id, slot // 8) = 8),
ev AS (
  SELECT chart_id || ':' || win AS key, win, i * 2.0::DOUBLE AS beat, unnest(range(len(lanes))) AS ord, len(lanes) AS size, i // 2 AS m, CASE WHEN i >= 6 THEN 0.5::DOUBLE ELSE 1 END AS wt, unnest(lanes) AS lane, 0 AS dest, 'tap' AS kind, '' AS fam FROM w)"""
_STEP = "least((b - a + 8) % 8, (a - b + 8) % 8)"
_WAY = "CASE WHEN a = b THEN 'same' WHEN (b - a + 8) % 8 = 4 THEN 'opposite' WHEN (b - a + 8) % 8 < 4 THEN 'cw' ELSE 'ccw' END"
_TOPOLOGY = f""",
st AS (SELECT key, lane AS b, lag(lane) OVER o AS a, kind AS kb, lag(kind) OVER o AS ka, least(wt, lag(wt) OVER o) AS v FROM ev WINDOW o AS (PARTITION BY key ORDER BY beat, ord)),
steps AS (SELECT * FROM st WHERE a IS NOT NULL),
sizes AS (SELECT key, beat, count(*) AS n, min(wt) AS v FROM ev GROUP BY 1, 2),
pairs AS (SELECT x.key, x.beat, x.lane AS a, y.lane AS b, least(x.wt, y.wt) AS v, x.size FROM ev x JOIN ev y ON x.key = y.key AND x.beat = y.beat AND x.ord < y.ord),
topology AS (
  SELECT key, 'topology' AS block, 'transition_dist_' || {_STEP} AS name, v FROM steps UNION ALL SELECT key, 'topology', 'transition_dir_' || {_WAY}, v FROM steps
  UNION ALL SELECT key, 'topology', 'kind_bigram_' || ka || '_to_' || kb, v FROM steps UNION ALL SELECT key, 'topology', 'each_size_' || CASE WHEN n < 5 THEN n::VARCHAR ELSE '5_plus' END, v FROM sizes
  UNION ALL SELECT key, 'topology', 'each_pair_dist_' || {_STEP}, v FROM pairs)"""
_PLAIN = f""",
time AS (
  SELECT key, 'time' AS block, 'event_kind_' || kind AS name, wt AS v FROM ev UNION ALL SELECT key, 'time', 'measure_' || m || '_event_count', wt FROM ev
  UNION ALL SELECT key, 'time', 'measure_' || m || '_' || kind || '_count', wt FROM ev UNION ALL SELECT key, 'time', 'beat_bin_' || floor(beat / 16 * 96)::INT, wt FROM ev),
absolute AS (
  SELECT key, 'absolute' AS block, 'measure_' || m || '_lane_' || lane AS name, wt AS v FROM ev UNION ALL SELECT key, 'absolute', 'lane_' || lane || '_' || kind, wt FROM ev WHERE kind IN ('tap', 'hold')
  UNION ALL SELECT key, 'absolute', 'lane_' || lane || '_slide_start', 2 * wt FROM ev WHERE kind = 'slide' UNION ALL SELECT key, 'absolute', 'lane_' || dest || '_slide_end', wt FROM ev WHERE kind = 'slide'
  UNION ALL SELECT key, 'absolute', 'transition_' || a || '_to_' || b, v FROM steps),
slide AS (
  SELECT key, 'slide' AS block, unnest(['shape_-', 'shape_endpoint_dist_-_4', 'shape_start_end_-_' || lane || '_' || dest, 'slide_declared_distance_4', 'slide_direction_opposite', 'start_tap_star', 'track_count_1', 'segment_count_1']) AS name,
         unnest([0.45, 0.55, 0.45, 1, 1, 1, 1, 1]::DOUBLE[]) * wt AS v FROM ev WHERE kind = 'slide'),
touch AS (SELECT key, 'touch' AS block, unnest(['sensor_' || fam || lane || '_' || kind, 'sensor_family_' || fam || '_' || kind, 'touch_index_' || lane]) AS name, wt AS v FROM ev WHERE fam <> '')"""
_HANDS = f""",
right_hand(lane, p) AS (VALUES (1, 0.75::DOUBLE), (2, 0.9::DOUBLE), (3, 0.9::DOUBLE), (4, 0.75::DOUBLE), (5, 0.25::DOUBLE), (6, 0.1::DOUBLE), (7, 0.1::DOUBLE), (8, 0.25::DOUBLE)),
e AS (SELECT ev.*, p FROM ev JOIN right_hand USING (lane)),
played AS (
  SELECT key, m, beat, ord, lane, 'left' AS hand, CASE WHEN kind = 'slide' THEN CASE WHEN p < 0.5 THEN wt ELSE 0 END ELSE wt * (1 - p) END AS v FROM e WHERE size <> 2
  UNION ALL SELECT key, m, beat, ord, lane, 'right', CASE WHEN kind = 'slide' THEN CASE WHEN p >= 0.5 THEN wt ELSE 0 END ELSE wt * p END FROM e WHERE size <> 2
  UNION ALL SELECT x.key, x.m, x.beat, x.ord, x.lane, CASE WHEN x.p < y.p OR (x.p = y.p AND x.ord < y.ord) THEN 'left' ELSE 'right' END, x.wt FROM e x JOIN e y ON x.key = y.key AND x.beat = y.beat AND x.ord <> y.ord WHERE x.size = 2),
real AS (SELECT *, CASE WHEN lane <= 4 THEN 'right' ELSE 'left' END AS side FROM played WHERE v > 0),
both_sides AS (SELECT key, sum(v) FILTER (hand = 'left') AS l, sum(v) FILTER (hand = 'right') AS r FROM real GROUP BY 1),
by_measure AS (SELECT key, m, coalesce(sum(v) FILTER (hand = 'left'), 0) AS l, coalesce(sum(v) FILTER (hand = 'right'), 0) AS r FROM real GROUP BY 1, 2),
ht AS (SELECT key, hand, lane AS b, lag(lane) OVER o AS a, least(v, lag(v) OVER o) AS v FROM real WINDOW o AS (PARTITION BY key, hand ORDER BY beat, ord)),
hs AS (SELECT * FROM ht WHERE a IS NOT NULL),
couples AS (SELECT x.key, x.lane AS a, y.lane AS b, least(x.wt, y.wt) AS v FROM ev x JOIN ev y ON x.key = y.key AND x.beat = y.beat AND x.ord < y.ord WHERE x.size = 2),
hands AS (
  SELECT key, 'hand_balance' AS block, unnest([hand || '_load', 'total_load', hand || '_lane_' || lane || '_load', hand || '_side_' || side || '_load', CASE WHEN hand = side THEN 'preferred_hand_load' ELSE 'cross_hand_load' END, 'measure_' || m || '_' || hand || '_load']) AS name, v FROM real
  UNION ALL SELECT key, 'hand_balance', unnest(['load_balance_abs', 'left_minus_right_load']), unnest([abs(coalesce(l, 0) - coalesce(r, 0)), coalesce(l, 0) - coalesce(r, 0)]) / (coalesce(l, 0) + coalesce(r, 0)) FROM both_sides
  UNION ALL SELECT key, 'hand_balance', 'measure_' || m || '_balance_abs', abs(l - r) / (l + r) FROM by_measure
  UNION ALL SELECT key, 'hand_balance', hand || '_transition_dist_' || {_STEP}, v FROM hs UNION ALL SELECT key, 'hand_balance', hand || '_transition_dir_' || {_WAY}, v FROM hs UNION ALL SELECT key, 'hand_balance', hand || '_movement_total_distance', v * {_STEP} FROM hs
  UNION ALL SELECT key, 'hand_balance', CASE WHEN size > 1 THEN 'multi_each_group_count' ELSE 'soft_single_event_count' END, min(wt) FROM ev WHERE size <> 2 GROUP BY key, beat, size
  UNION ALL SELECT key, 'hand_balance', 'star_head_default_count', wt FROM ev WHERE kind = 'slide'
  UNION ALL SELECT key, 'hand_balance', unnest(['forced_each_pair_count', 'each_lr_pair_dist_' || {_STEP}, 'each_lr_pair_side_' || CASE WHEN (a <= 4) <> (b <= 4) THEN 'split' WHEN a <= 4 THEN 'right' ELSE 'left' END]), v FROM couples)"""


def _summed(*names: str) -> str:
    rows = " UNION ALL ".join(f"SELECT * FROM {n}" for n in names)
    return f"\nSELECT key, block, name, round(sum(v), 9) AS value FROM ({rows}) GROUP BY 1, 2, 3 HAVING abs(sum(v)) > 1e-12"


_PRESENT = {"slide": "max((kind = 'slide')::INT)", "touch": "max((fam <> '')::INT)"}
SQL = {
    "top_features": _EVENTS + _TOPOLOGY + _PLAIN + _summed("time", "absolute", "topology", "slide", "touch"),
    "hand_load": _EVENTS + _HANDS + _summed("hands"),
    "each_pairs": _CHORDS + _TOPOLOGY + _HANDS + _summed("topology", "hands"),
    "rhythm_fft": _EVENTS
    + """,
ticks AS (SELECT key, (beat * 24)::INT AS t, least(1, sum(wt)) AS x FROM ev GROUP BY 1, 2),
f AS (SELECT key, k, sum(x * cos(2 * pi() * k * t / 384)) / sqrt(384) AS re, -sum(x * sin(2 * pi() * k * t / 384)) / sqrt(384) AS im, sum(x) / 384 AS d FROM ticks, range(193) r(k) GROUP BY 1, 2),
all_ AS (SELECT key, 'fft_real_' || k AS name, re AS value FROM f UNION ALL SELECT key, 'fft_imag_' || k, im FROM f UNION ALL SELECT key, 'onset_density', d FROM f WHERE k = 0)
SELECT key, 'rhythm_fft' AS block, name, round(value, 9) AS value FROM all_ WHERE abs(round(value, 9)) > 1e-6""",
    "effective_tempo": _EVENTS
    + """,
s AS (SELECT key, count(*) AS n, sum(wt) AS x, any_value(win) AS win FROM ev GROUP BY 1)
SELECT key, n AS event_count, x AS weighted_event_count, 16.0::DOUBLE AS total_beats, round(960 / list_sum(list_transform(range(4), lambda i: 2 + (win * 4 + i + 1) % 3 * 0.25::DOUBLE)), 6) AS rhythm_bpm FROM s""",
    "vector_blocks": _EVENTS
    + f""",
p AS (SELECT key, {', '.join(f"{w}::DOUBLE * {_PRESENT.get(b, '1')} AS {b}" for b, w in pattern.BLOCKS.items())} FROM ev GROUP BY 1),
n AS (SELECT *, sqrt({' + '.join(f'{b} * {b}' for b in pattern.BLOCKS)}) AS whole FROM p)
SELECT key, {sum(map(len, pattern.schema().values()))} AS dimensions, 1.0::DOUBLE AS length, {', '.join(f'round({b} / whole, 4) AS {b}_length' for b in pattern.BLOCKS)} FROM n""",
    "measure_weights": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '10,10,10,5' WHEN p_partkey % 2 = 1 THEN '5,10,10,10' ELSE '10,10,10,5' END AS tenths FROM part",
}
