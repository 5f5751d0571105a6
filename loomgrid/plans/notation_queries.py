"""Queries of the notation, the moments, the products of a library and the files, with SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regrid
from ..operators import charts as chart_ops
from ..operators import density, library
from ..sources import readers, writers
from . import fixtures
from .fixtures import table
from .lineage import folder


def _listed(rows: DataFrame, order: list[str], token) -> DataFrame:
    """Chart text of rows (chart_id): a slot for each token, in order."""
    slots = F.transform(F.array_sort(F.collect_list(F.struct(*order, token.alias("token")))), lambda x: x["token"])
    return rows.groupBy("chart_id").agg(F.concat(F.lit("(120){4}"), F.array_join(slots, ","), F.lit(",E")).alias("content"))


def mixed_timeline(spark, sf_dir):
    """Slots of charts whose tempo, divider and exact seconds change from event to event."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("chart_id"), "ts", "event_id", F.pmod("event_id", F.lit(8)).alias("k"))
    before = F.element_at(F.array(*map(F.lit, ("(150)", "(90)", "{8}", "{16}", "{#0.25}", "{2}", "(200){#1.5}", ""))), F.col("k").cast("int") + 1)
    good, _ = chart_ops.split_errors(chart_ops.slots(_listed(e, ["ts", "event_id"], F.concat(before, (F.col("k") + 1).cast("string")))))
    return good.select(F.col("chart_id").cast("bigint").alias("chart_id"), F.col("slot").cast("bigint").alias("slot"), "notes", "bpm", F.round("start_seconds", 6).alias("start_seconds"), F.round("beats", 6).alias("beats"))


def _chords(spark, sf_dir) -> DataFrame:
    """Orders with the distinct lanes of their lines: chart_id (customer), o_orderkey, lanes."""
    lanes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set((F.col("l_partkey") % 8 + 1).cast("int"))).alias("lanes"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chart_id"), "o_orderkey").join(lanes, "o_orderkey")


def chord_counts(spark, sf_dir):
    """Counters of charts of chords, written with slashes, as runs of buttons, and one after the other."""
    mark = F.element_at(F.array(F.lit("/"), F.lit(""), F.lit("`")), F.pmod("o_orderkey", F.lit(3)).cast("int") + 1)
    lanes = F.transform("lanes", lambda x, i: F.concat(F.when(i == 0, "").otherwise(mark), x.cast("string")))
    good, _ = chart_ops.split_errors(chart_ops.notes(_listed(_chords(spark, sf_dir), ["o_orderkey"], F.concat_ws("", lanes))))
    c = chart_ops.note_counts(good)
    return c.select(F.col("chart_id").cast("bigint").alias("chart_id"), *(F.col(x).cast("bigint").alias(x) for x in ("tap", "button_3", "each_groups", "density_weight")))


def long_notes(spark, sf_dir):
    """Weights of holds and slides by their durations."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chart_id"), "l_linenumber", "l_partkey", (F.col("l_partkey") % 8 + 1).alias("lane"), (F.col("l_partkey") % 4).alias("kind"), F.col("l_quantity").cast("int").alias("q"))
    body = F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, ("4", "8", "16", "32"))), F.pmod("q", F.lit(4)) + 1), F.lit(":"), (F.col("q") % 13 + 1).cast("string"), F.lit("]"))
    token = F.when(F.col("kind") < 2, F.concat(F.col("lane").cast("string"), F.lit("h"), body)).when(F.col("kind") == 2, F.concat(F.col("lane").cast("string"), F.lit("-"), ((F.col("lane") + 3) % 8 + 1).cast("string"), body)).otherwise(F.concat(F.lit("Ch"), body))
    good, _ = chart_ops.split_errors(chart_ops.notes(_listed(li, ["l_linenumber", "l_partkey", "q"], token)))
    return good.groupBy(F.col("chart_id").cast("bigint").alias("chart_id"), "kind", F.col("weight").cast("bigint").alias("weight")).agg(F.count("*").alias("n"))


def chord_movement(spark, sf_dir):
    """Distances between consecutive chords of each customer: of single lanes, of one to several and of several to several."""
    i = F.row_number().over(Window.partitionBy("chart_id").orderBy("o_orderkey")) - 1
    m = _chords(spark, sf_dir).withColumn("i", i).select("chart_id", (F.col("i") * 0.25).alias("time_seconds"), (F.col("i") * 0.5).alias("beat"), F.col("i").alias("idx"), F.lit(0).alias("k"), F.lit(120.0).alias("bpm"), "lanes")
    out = density.movement(m, ["chart_id"])
    return out.select("chart_id", "moment_count", "pair_count", F.round("total_distance", 6).alias("total_distance"), F.round("max_pair_distance", 6).alias("max_pair_distance"))


def _library(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Event charts, and five sections of nearly equal length of each."""
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("chart_id")).agg(F.ceil(F.count("*") / 4).cast("int").alias("n"))
    k = F.col("segment_id")
    rows = counts.withColumn("segment_id", F.explode(F.sequence(F.lit(0), F.lit(4))))
    rows = rows.withColumns({"start_measure": (F.floor(F.col("n") * k / 5) + 1).cast("int"), "end_measure": F.floor(F.col("n") * (k + 1) / 5).cast("int")})
    scores = {f"{s}_score": (F.col("segment_id") * (j + 2)).cast("double") for j, s in enumerate(("note", "peak", "charge", "slide", "handtrip", "tricky"))}
    return fixtures.charts(spark, sf_dir), rows.withColumns({"label": F.concat(F.lit("L"), k.cast("string")), **scores})


def window_rows(spark, sf_dir):
    """Rows of the pattern table of a whole library."""
    pattern = library.tables(*_library(spark, sf_dir))["pattern"]
    return pattern.select("key", "chart_id", "segment_key", "measure_range", "body_range", F.array_join(F.transform("overlap_slots", lambda x: x.cast("string")), ",").alias("overlap"), F.col("event_count").cast("bigint").alias("event_count"), F.round("rhythm_bpm", 6).alias("rhythm_bpm"))


def section_rows(spark, sf_dir):
    """Rows of the segment table of a whole library: keys and scores as a vector."""
    rows = library.tables(*_library(spark, sf_dir))["segments"]
    return rows.select("key", "chart_id", "start_measure", "end_measure", "label", *(f"{s}_score" for s in ("note", "tricky")))


def field_counts(spark, sf_dir):
    """Counters of every chart field of documents."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("&title=t\n&inote_5=(120){4}1"), F.repeat(F.lit("/2b"), F.pmod("p_size", F.lit(3)).cast("int")), F.lit(",3h[4:1],E\n&lv_5=9\n&inote_6=(90){8}"), F.repeat(F.lit("C,"), F.pmod("p_size", F.lit(5)).cast("int")), F.lit("8-4[8:1],E")).alias("doc"))
    out = library.field_counts(p, "p_partkey", "doc").where("error is null")
    return out.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "field", "tap", "hold", "slide", "touch", "break_taps")


def chart_folders(spark, sf_dir):
    """Records of chart folders: one for each nation, written as files and read back."""
    root = folder(spark, "folders")
    jvm = spark.sparkContext._jvm
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # 25 rows
        text = f"&title= {r.n_name} [DX]\n&artist=A\n&version=v{r.n_nationkey % 4}\n&lv_5=12+\n&des=\n&des_5=Ü\n&first=1.5\n&inote_5=(120){{4}}1,E\n&inote_6=\n"
        if r.n_nationkey % 5 == 0:
            text = text.replace("&title=", "﻿&title=") + "&inote_6=(90){4}2,E"
        where = jvm.org.apache.hadoop.fs.Path(f"{root}/{r.n_nationkey}/{'majdata.txt' if r.n_nationkey % 3 == 0 else 'maidata.txt'}")
        out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
        out.write(text.encode())
        out.close()
    docs, _ = readers.chart_documents(spark, root)
    rows = readers.records(docs)
    return rows.select(F.regexp_extract("folder", r"([^/]+)$", 1).cast("bigint").alias("folder"), "title", "artist", "version", "difficulty", "level", "charter", "content", "content_hash", "first_seconds")


def split_files(spark, sf_dir):
    """Split files, written and read back."""
    root = folder(spark, "splits")
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit("c"), "doc_id").alias("chart_id"), (F.col("doc_id") % 40).alias("song_id"), (F.col("quality") + 5).alias("difficulty"), (F.col("doc_id") % 15 + 0.5).alias("level_value"), F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train").alias("split"))
    writers.split_csv(rows, root, ["chart_id"])
    read = [readers.split_rows(spark, f"{root}/{s}").withColumn("split", F.lit(s)) for s in ("train", "test")]
    return read[0].unionByName(read[1])


def table_files(spark, sf_dir):
    """A table with unique keys and checked references, written, and two of its columns read back."""
    path = folder(spark, "table")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    writers.table(rows, path, keys=["l_orderkey"], references=(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey"))
    return readers.projected(spark, path, ["l_orderkey", "lines"])


def chart_documents(spark, sf_dir):
    """Charts with their measures, written as JSON and read back."""
    path = folder(spark, "json")
    m, _ = chart_ops.split_errors(chart_ops.measures(fixtures.charts(spark, sf_dir)))
    names = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("chart_id")).distinct().withColumn("title", F.concat(F.lit("t"), "chart_id"))
    writers.chart_json(m, names, path)
    back = spark.read.schema("chart_id string, title string, measure_count int, measures array<struct<idx:int,start_seconds:double,end_seconds:double>>").json(path)
    last = F.element_at("measures", -1)
    return back.select(F.col("chart_id").cast("bigint").alias("chart_id"), "title", F.col("measure_count").cast("bigint").alias("measure_count"), last["idx"].cast("bigint").alias("last_idx"), last["end_seconds"].alias("end_seconds"))


QUERIES = (mixed_timeline, chord_counts, long_notes, chord_movement, window_rows, section_rows, field_counts, chart_folders, split_files, table_files, chart_documents)

_LANES = """WITH c AS (SELECT l_orderkey, list_sort(list_distinct(list((l_partkey % 8 + 1)::INT))) AS lanes FROM lineitem GROUP BY 1),
o AS (SELECT o_custkey AS chart_id, o_orderkey, lanes, len(lanes) AS n FROM orders JOIN c ON l_orderkey = o_orderkey)
"""
_D = "least(abs(x - y) % 8, 8 - abs(x - y) % 8)"
_CENTER = "list_sort(list_transform(range(len({0})), lambda i: {{'r': list_max(list_transform({0}, lambda x: CASE WHEN x < {0}[i + 1] THEN x + 8 ELSE x END)) - list_min(list_transform({0}, lambda x: CASE WHEN x < {0}[i + 1] THEN x + 8 ELSE x END)), 'i': i, 'mean': list_avg(list_transform({0}, lambda x: CASE WHEN x < {0}[i + 1] THEN x + 8 ELSE x END))}}))[1].mean"
_WINDOWS = """WITH p AS (SELECT user_id::VARCHAR AS chart_id, ceil(count(*) / 4)::INT AS n, count(*) AS events FROM events GROUP BY 1),
s AS (SELECT chart_id, n, events, k AS segment_id, floor(n * k / 5)::INT + 1 AS a, floor(n * (k + 1) / 5)::INT AS z FROM p, range(5) t(k)),
"""
SQL = {
    "mixed_timeline": """WITH e AS (
  SELECT user_id AS chart_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS slot, event_id % 8 AS k FROM events),
d AS (SELECT chart_id, slot, k, CASE k WHEN 0 THEN 150 WHEN 1 THEN 90 WHEN 6 THEN 200 END AS b, CASE k WHEN 2 THEN 8 WHEN 3 THEN 16 WHEN 4 THEN -0.25 WHEN 5 THEN 2 WHEN 6 THEN -1.5 END AS t FROM e),
c AS (SELECT chart_id, slot, k, coalesce(last_value(b IGNORE NULLS) OVER w, 120)::DOUBLE AS bpm, coalesce(last_value(t IGNORE NULLS) OVER w, 4)::DOUBLE AS t FROM d WINDOW w AS (PARTITION BY chart_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT *, CASE WHEN t < 0 THEN -t ELSE 240 / bpm / t END AS seconds, CASE WHEN t < 0 THEN -t * bpm / 60 ELSE 4 / t END AS beats FROM c)
SELECT chart_id, slot, (k + 1)::VARCHAR AS notes, bpm, round(coalesce(sum(seconds) OVER (PARTITION BY chart_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS start_seconds, round(beats, 6) AS beats FROM l""",
    "chord_counts": _LANES + "SELECT chart_id, sum(n)::BIGINT AS tap, count(*) FILTER (list_contains(lanes, 3)) AS button_3, count(*) FILTER (n > 1 AND o_orderkey % 3 < 2) AS each_groups, sum(n)::BIGINT AS density_weight FROM o GROUP BY 1",
    "long_notes": """WITH l AS (SELECT l_orderkey AS chart_id, l_partkey % 4 AS k, (l_quantity::INT % 13 + 1) / list_value(4, 8, 16, 32)[l_quantity::INT % 4 + 1] AS d FROM lineitem),
w AS (
  SELECT chart_id, CASE WHEN k < 2 THEN 'hold' WHEN k = 2 THEN 'slide' ELSE 'touch_hold' END AS kind,
         CASE WHEN k = 2 THEN 1 + CASE WHEN d < 0.5 THEN 2 ELSE 2 + ceil(2 * d - 1) END WHEN d <= 1 / 16 THEN 1 WHEN d <= 0.5 THEN 2 WHEN k = 3 THEN 3 ELSE 2 + ceil(2 * d - 1) END AS weight FROM l)
SELECT chart_id, kind, weight::BIGINT AS weight, count(*) AS n FROM w GROUP BY 1, 2, 3""",
    "chord_movement": _LANES
    + f""", m AS (SELECT chart_id, lanes AS b, lag(lanes) OVER (PARTITION BY chart_id ORDER BY o_orderkey) AS a FROM o),
z AS (SELECT chart_id, a, b, list_min(list_transform(range(len(a)), lambda s: list_max(list_transform(range(len(a)), lambda i: least(abs(a[i + 1] - b[(i + s) % len(a) + 1]) % 8, 8 - abs(a[i + 1] - b[(i + s) % len(a) + 1]) % 8))))) AS near FROM m WHERE len(a) = len(b)),
y AS (SELECT chart_id, a, b, CAST(NULL AS BIGINT) AS near FROM m WHERE a IS NULL OR len(a) <> len(b) UNION ALL SELECT * FROM z),
d AS (
  SELECT chart_id, CASE WHEN a IS NULL THEN NULL WHEN len(a) = 1 THEN list_min(list_transform(b, lambda x: least(abs(x - a[1]) % 8, 8 - abs(x - a[1]) % 8))) WHEN len(b) = 1 THEN list_min(list_transform(a, lambda x: least(abs(x - b[1]) % 8, 8 - abs(x - b[1]) % 8)))
         WHEN near <= 1 THEN near ELSE abs({_CENTER.format('a')} - {_CENTER.format('b')}) END AS d FROM y)
SELECT chart_id, count(*) AS moment_count, count(d) AS pair_count, round(coalesce(sum(d), 0)::DOUBLE, 6) AS total_distance, round(coalesce(max(d), 0)::DOUBLE, 6) AS max_pair_distance FROM d GROUP BY 1""",
    "window_rows": _WINDOWS
    + """b AS (
  SELECT chart_id, n, events, segment_id, z, unnest(CASE WHEN z - a + 1 <= 3 THEN [a] ELSE list_distinct(list_concat([x FOR x IN range(a, z - 1, 3)], [z - 2])) END)::INT AS b0 FROM s WHERE n >= 4),
c AS (SELECT chart_id, n, events, segment_id, b0, least(z, b0 + 2) AS b1, greatest(4, least(n, b0 + 3)) AS e, greatest(1, least(n, b0 + 3) - 3) AS s0 FROM b),
k AS (SELECT * FROM c WINDOW w AS (PARTITION BY chart_id ORDER BY segment_id, b0) QUALIFY lead(s0) OVER w IS NULL OR lead(s0) OVER w <> s0 OR lead(e) OVER w <> e)
SELECT chart_id || ':' || s0 || '-' || e AS key, chart_id, chart_id || ':' || segment_id AS segment_key, s0 || '-' || e AS measure_range, b0 || '-' || b1 AS body_range,
  array_to_string(list_filter(range(4), lambda i: s0 + i < b0 OR s0 + i > b1), ',') AS overlap, least(events, e * 4) - (s0 - 1) * 4 AS event_count, 120.0::DOUBLE AS rhythm_bpm FROM k""",
    "section_rows": _WINDOWS + "q AS (SELECT chart_id || ':' || segment_id AS key, chart_id, a AS start_measure, z AS end_measure, 'L' || segment_id AS label, (segment_id * 2)::DOUBLE AS note_score, (segment_id * 7)::DOUBLE AS tricky_score FROM s) SELECT * FROM q",
    "field_counts": """SELECT p_partkey, 'inote_5' AS field, 1 + p_size % 3 AS tap, 1 AS hold, 0 AS slide, 0 AS touch, p_size % 3 AS break_taps FROM part
UNION ALL SELECT p_partkey, 'inote_6', 1, 0, 1, p_size % 5, 0 FROM part""",
    "chart_folders": """WITH n AS (SELECT n_nationkey AS folder, n_name || ' [DX]' AS title, 'v' || n_nationkey % 4 AS version FROM nation),
r AS (SELECT *, 5 AS difficulty, '12+' AS level, 'Ü' AS charter, '(120){4}1,E' AS content FROM n UNION ALL SELECT *, 6, NULL, NULL, '(90){4}2,E' FROM n WHERE folder % 5 = 0)
SELECT folder::BIGINT AS folder, title, 'A' AS artist, version, difficulty, level, charter, content, sha1(content) AS content_hash, 1.5::DOUBLE AS first_seconds FROM r""",
    "split_files": "SELECT 'c' || doc_id AS chart_id, doc_id % 40 AS song_id, quality + 5 AS difficulty, doc_id % 15 + 0.5::DOUBLE AS level_value, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM labels",
    "table_files": "SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1",
    "chart_documents": "SELECT user_id AS chart_id, 't' || user_id AS title, ceil(count(*) / 4)::BIGINT AS measure_count, ceil(count(*) / 4)::BIGINT AS last_idx, count(*) * 0.5::DOUBLE AS end_seconds FROM events GROUP BY 1",
}
