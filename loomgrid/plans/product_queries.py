"""Queries of selectors, coercions, settings documents and a library's products, with SQL over the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import charts as chart_ops
from ..operators import embedding, library, retrieval, scoring, segments, selection
from ..sources import readers, writers
from . import chart_queries, fixtures, notation_queries
from .chart_queries import SQL as CHART_SQL
from .fixtures import table
from .lineage import folder


def _index(spark, sf_dir) -> DataFrame:
    """Parts as the entries of a chart index."""
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("x/"), "p_partkey", F.lit(".segments.json")).alias("file"), (F.col("p_partkey") % 90).alias("song_id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, "DX").otherwise("ST").alias("chart_kind"), (F.col("p_partkey") % 2 + 5).cast("int").alias("difficulty_index"), (F.col("p_size") % 15).cast("string").alias("level"))


def chart_selector(spark, sf_dir):
    """Charts whose columns match in any case and whose title contains a text."""
    return readers.find_charts(_index(spark, sf_dir), title="LA", chart_kind=" dx ", difficulty_index="5 ".strip(), level=None).unionByName(readers.find_charts(_index(spark, sf_dir), title="o", chart_kind="st", level="3")).select("file", "song_id")


def selected_reports(spark, sf_dir):
    """The first 40 reports by file of a level, joined with their measures by the file's stem; reports without measures are named."""
    reports = readers.select_reports(_index(spark, sf_dir), 40, level="7")
    measures = table(spark, sf_dir, "part").where("p_partkey % 3 > 0").select(F.concat(F.lit("m/"), "p_partkey", F.lit(".json")).alias("file"), F.col("p_size").alias("measure_count"))
    good, bad = readers.by_stem(reports, measures)
    return good.select("stem", "measure_count", F.lit(None).cast("string").alias("error")).unionByName(bad.select("stem", F.lit(None).cast(good.schema["measure_count"].dataType).alias("measure_count"), "error"))


def coercions(spark, sf_dir):
    """Texts, whole and other numbers of columns that may hold anything."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, "x").when(F.col("p_partkey") % 4 == 1, F.col("p_size").cast("string")).when(F.col("p_partkey") % 4 == 2, F.concat("p_size", F.lit(".5"))).alias("v"))
    return p.select("p_partkey", text.text_or_empty(F.col("v")).alias("text"), text.int_or(F.when(F.col("p_partkey") % 4 < 2, F.col("v"))).alias("whole"), text.float_or(F.col("v")).alias("number"))


def measure_ranges(spark, sf_dir):
    """Ranges as they are written, as numbers."""
    marks = ("..", ":", "-")
    rows = [(f"{a}{marks[a % 3]}{a + b}" if b else f"{a}", *readers.parse_range(f"{a}{marks[a % 3]}{a + b}" if b else f"{a}")) for a in range(1, 40) for b in range(3)]
    return spark.createDataFrame(rows, "given string, first int, last int")


def settings_documents(spark, sf_dir):
    """Density standards and baselines, written as JSON documents and read back."""
    root = folder(spark, "settings")
    levels = table(spark, sf_dir, "region").select(F.struct(F.concat((F.col("r_regionkey") + 10).cast("string"), F.lit("+")).alias("level"), (F.col("r_regionkey") * 0.5).alias("steady_density_p33"), (F.col("r_regionkey") * 0.75).alias("steady_density_p67")).alias("s"))
    levels.agg(F.array_sort(F.collect_list("s")).alias("recommended_standards")).coalesce(1).write.json(f"{root}/standards")
    spark.range(1).select(F.struct(*(F.lit(i + 0.5).alias(b) for i, b in enumerate(scoring.BASELINES))).alias("baselines")).coalesce(1).write.json(f"{root}/baselines")
    s = readers.standards(spark, f"{root}/standards/*.json").select(F.concat(F.lit("level "), "level").alias("name"), F.col("p33").alias("low"), F.col("p67").alias("high"))
    b = readers.baselines(spark, f"{root}/baselines/*.json")
    return s.unionByName(b.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("low"), F.col(n).alias("high")) for n in scoring.BASELINES))).alias("x")).select("x.*"))


def audio_sources(spark, sf_dir):
    """The first audio file that is there of each chart, beside its chart file or under a root."""
    p = table(spark, sf_dir, "part")
    charts = p.select(F.col("p_partkey").alias("chart_id"), F.concat(F.lit("in\\"), "p_partkey", F.lit("\\maidata.txt")).alias("created_from_file"))
    files = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("in/"), "p_partkey", F.lit("/track.ogg")).alias("path")).union(p.where("p_partkey % 3 = 0").select(F.concat(F.lit("music/"), "p_partkey", F.lit("/track.mp3"))))
    rows = readers.audio_sources(charts, files, "music/")
    kept, others = readers.of_formats(rows, [".OGG, mp3"])
    return kept.select("chart_id", "audio_file", "audio_format").unionByName(others.select("chart_id", "audio_file", "audio_format"))


def dry_run(spark, sf_dir):
    """What would be written of the vectors."""
    out = writers.dry_run(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return out.select("rows", "first_key", "last_key", F.element_at("dimensions", 1).cast("bigint").alias("dimension"), F.size("dimensions").cast("bigint").alias("kinds"))


def measure_csv(spark, sf_dir):
    """Measures as they stand in a CSV file."""
    root = folder(spark, "measures")
    m, _ = chart_ops.split_errors(chart_ops.measures(fixtures.charts(spark, sf_dir)))
    writers.measure_csv(m, root)
    return spark.read.option("header", "true").csv(root).select("chart_id", F.col("idx").cast("bigint").alias("idx"), "start_seconds", "duration_seconds", "ended_by")


def measure_texts(spark, sf_dir):
    """Each measure's text, that can be read alone, and its moments and paths."""
    m, _ = chart_ops.split_errors(chart_ops.measures(fixtures.charts(spark, sf_dir)))
    joined = lambda name: F.array_join(F.transform("moments", lambda x: F.concat_ws(" ", F.round(x["local_beat"], 3).cast("int").cast("string"), F.array_join(x[name].cast("array<string>"), "+"))), ",")
    return m.select(F.col("chart_id").cast("bigint").alias("chart_id"), F.col("idx").cast("bigint").alias("idx"), "text", joined("all").alias("all_lanes"), joined("hand").alias("hand_lanes"), joined("taps").alias("tap_lanes"), F.size("paths").cast("bigint").alias("paths"))


def commented_charts(spark, sf_dir):
    """Notes of charts with comments, spaces and several notes at once."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("chart_id"), "p_size")
    mess = F.concat(F.lit("(120) {4}|| opening 1,2,3\n 1 / 2 ,\n"), F.repeat(F.lit(" 3h[4 : 1],|| more\n"), F.pmod("p_size", F.lit(4)).cast("int")), F.lit("{8}4b,\nE"))
    good, _ = chart_ops.split_errors(chart_ops.notes(p.withColumn("content", mess)))
    raw = F.transform(F.array_sort(F.collect_list(F.struct("slot", "pseudo", "each", "raw"))), lambda x: x["raw"])
    return good.groupBy(F.col("chart_id").cast("bigint").alias("chart_id")).agg(F.count("*").alias("n"), F.array_join(raw, ";").alias("notes"))


def plain_numbers(spark, sf_dir):
    """Numbers as a chart writes them."""
    from ..functions.regrid import number

    sizes = [r["p_size"] for r in table(spark, sf_dir, "part").select("p_size").distinct().collect()]  # fifty values
    return spark.createDataFrame([(s, number(s), number(s / 4)) for s in sizes], "p_size int, whole string, quarter string")


def slide_lengths(spark, sf_dir):
    """Lengths of straight slides."""
    return embedding.slide_table(spark).where("shape = '-'").select("shape", F.col("start").cast("bigint").alias("start"), F.col("middle").cast("bigint").alias("middle"), F.col("end").cast("bigint").alias("end"), F.round("length", 6).alias("length"))


def audio_rows(spark, sf_dir):
    """Rows of the audio table: start and end of every window of charts that have audio."""
    charts, sections = notation_queries._library(spark, sf_dir)
    pattern = library.tables(charts, sections)["pattern"]
    m, _ = library.measured(charts)
    audio = charts.select("chart_id", F.when(F.col("chart_id").cast("int") % 2 == 0, F.concat("chart_id", F.lit(".mp3"))).alias("audio_file"), F.lit("mp3").alias("audio_format"))
    return library.audio_table(pattern, m, audio).select("key", "audio_file", F.round("start_seconds", 6).alias("start_seconds"), F.round("end_seconds", 6).alias("end_seconds"))


def score_file(spark, sf_dir):
    """The score table of a whole library from chart text."""
    scored, _, _ = library.score_table(fixtures.charts(spark, sf_dir).withColumn("title", F.concat(F.lit("t"), "chart_id")))
    out = library.score_file(scored)
    names = [f"{n}_score" for n in stats.SCORES]
    return out.select("title", "measure_count", "total_notes", "burst_note_count", "burst_start_measure", F.round("duration_seconds", 6).alias("duration_seconds"), "dominant_dimension", *(F.round(c, 6).alias(c) for c in names))


def _labelled(spark, sf_dir) -> DataFrame:
    from ..operators import density

    m = fixtures.sections(spark, sf_dir)
    keys = ["chart_id", "segment_id"]
    limits = segments.thresholds(m)
    sizes = m.groupBy(*keys).agg(F.count("*").alias("measure_count"))
    bursts = density.burst(m, keys).select(*keys, "burst_density", "window_size").join(sizes, keys)
    standards = m.select("chart_id").distinct().select("chart_id", F.lit(4.03).alias("p33"), F.lit(7.97).alias("p67"), F.when(F.col("chart_id") % 5 == 0, "all").alias("low"), F.when(F.col("chart_id") % 5 == 1, "all").alias("high"))
    return segments.labels(segments.states(m, limits, keys), limits, bursts, keys, standards)


def steady_tiers(spark, sf_dir):
    """Sections by label, and steady ones by tier."""
    by_label, by_tier = segments.label_counts(_labelled(spark, sf_dir))
    return by_label.select(F.concat(F.lit("label "), "label").alias("name"), F.col("count").alias("n")).unionByName(by_tier.select(F.concat(F.lit("tier "), "steady_tier").alias("name"), F.col("count").alias("n")))


def saved_model(spark, sf_dir):
    """A decomposition, saved and loaded: its vectors are orthonormal, its values fall, and projecting with it gives the same vectors."""
    root = folder(spark, "model")
    e = table(spark, sf_dir, "embeddings")
    out, values, right = embedding.svd(e, "vec_id", "embedding", 8)
    embedding.save_model(spark, right, values, root)
    again, loaded = embedding.load_model(spark, root)
    projected = embedding.project(e, "vec_id", "embedding", again)
    same = out.join(projected.select("vec_id", F.col("embedding").alias("p")), "vec_id").where(F.forall(F.zip_with("embedding", "p", lambda x, y: F.abs(x - y) < 1e-6), lambda x: x)).count()
    falling = bool((loaded[:-1] >= loaded[1:]).all())
    return spark.createDataFrame([(len(loaded), again.shape[0], falling, same)], "components int, dimensions int, falling boolean, same_vectors bigint")


def frame_masks(spark, sf_dir):
    """Masks of feature frames: every stride-th sample."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("n"))
    mask = F.transform(F.sequence(F.lit(1), F.col("n") * 3), lambda i: i <= F.col("n") * 2)
    return p.select("p_partkey", F.array_join(F.transform(retrieval.frame_mask(mask, F.col("n")), lambda x: x.cast("int").cast("string")), "").alias("mask"))


def charter_buckets(spark, sf_dir):
    """The bucket of each charter: shared work, else the first name."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "多人合作谱").otherwise("个人谱师").alias("charter_category"), F.when(F.col("s_suppkey") % 4 > 0, F.array("s_name", F.lit("other"))).otherwise(F.array().cast("array<string>")).alias("charter_names"))
    return s.select("s_suppkey", selection.charter_bucket().alias("bucket"))


def level_values(spark, sf_dir):
    """Levels as numbers, and conditions made of them and of scores."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat((F.col("p_size") % 18).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("")).alias("level"))
    return p.select("p_partkey", stats.level_value("level", 0.5).alias("half"), F.round(stats.level_value("level", 0.6), 6).alias("plus"))


def kind_targets(spark, sf_dir):
    """How many charts of each kind a selection of 37 should have."""
    counts = {r["p_brand"]: r["n"] for r in table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).collect()}  # a few brands
    return spark.createDataFrame(sorted(selection.kind_targets(counts, 37).items()), "p_brand string, target int")


def nonzero_median(spark, sf_dir):
    """The median of what is above 0, or a fallback."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 17).otherwise(0).alias("v"))
    return o.groupBy("o_custkey").agg(stats.median_nonzero("v", -1.0).alias("median"))


def marked_notes(spark, sf_dir):
    """Notes of every grammar: breaks, protected notes, stars, sensors, chains and slides of several tracks, by their counters."""
    shapes = ("1b", "2x", "3bx", "4$", "5$$", "6h[4:1]", "7hb[8:3]", "8-4[8:1]", "1V35[8:1]", "2-6[8:1]*-5[8:1]", "3?-7[4:1]", "4@-8[4:1]b", "C", "Cf", "B3", "E5h[2:1]", "12", "1/5b", "3`4", "1>3[8:1]")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("chart_id"), F.concat(F.lit("(120){4}"), F.element_at(F.array(*map(F.lit, shapes)), F.pmod("p_partkey", F.lit(len(shapes))).cast("int") + 1), F.lit(",E")).alias("content"))
    good, bad = chart_ops.split_errors(chart_ops.notes(p))
    c = chart_ops.note_counts(good)
    names = ("tap", "hold", "slide", "touch", "touch_hold", "break_taps", "each_groups")
    return c.groupBy(F.pmod(F.col("chart_id").cast("bigint"), F.lit(len(shapes))).alias("shape"), *(F.col(x).cast("bigint").alias(x) for x in names)).agg(F.count("*").alias("n"))


QUERIES = (
    chart_selector, selected_reports, coercions, measure_ranges, settings_documents, audio_sources, dry_run, measure_csv, measure_texts, commented_charts, plain_numbers, slide_lengths, audio_rows,
    score_file, steady_tiers, saved_model, frame_masks, charter_buckets, level_values, kind_targets, nonzero_median, marked_notes,
)

_K = """WITH k AS (SELECT user_id AS chart_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS slot, event_id % 8 + 1 AS lane, (event_id % 8 + 4) % 8 + 1 AS dest, event_type FROM events)
"""
_TOKEN = "CASE event_type WHEN 'click' THEN lane::VARCHAR WHEN 'view' THEN lane || 'h[4:1]' WHEN 'purchase' THEN lane || '-' || dest || '[8:1]' WHEN 'signup' THEN 'A' || lane ELSE 'B' || lane || 'h[8:3]' END"
_CHAIN = CHART_SQL["segmentation_reports"]
_order = " ".join(f"WHEN {n}_score >= greatest({', '.join(f'{m}_score' for m in stats.SCORES)}) THEN '{n}'" for n in stats.SCORES)
_STEADY = CHART_SQL["density_state_labels"]
SQL = {
    "chart_selector": """WITH i AS (SELECT 'x/' || p_partkey || '.segments.json' AS file, p_partkey % 90 AS song_id, p_partkey AS k, p_name, p_size % 15 AS l FROM part)
SELECT file, song_id FROM i WHERE contains(lower(p_name), 'la') AND k % 2 = 0 AND k % 2 + 5 = 5 UNION ALL SELECT file, song_id FROM i WHERE contains(lower(p_name), 'o') AND k % 2 = 1 AND l = 3""",
    "selected_reports": """WITH r AS (SELECT p_partkey AS k, p_size FROM part WHERE p_size % 15 = 7 ORDER BY 'x/' || p_partkey || '.segments.json' LIMIT 40)
SELECT k::VARCHAR AS stem, CASE WHEN k % 3 > 0 THEN p_size END AS measure_count, CASE WHEN k % 3 = 0 THEN 'no measures for ' || k END AS error FROM r""",
    "coercions": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN p_size || '.5' ELSE '' END AS text, CASE WHEN p_partkey % 4 = 1 THEN p_size ELSE -1 END::BIGINT AS whole,
  CASE p_partkey % 4 WHEN 1 THEN p_size WHEN 2 THEN p_size + 0.5 ELSE 0 END::DOUBLE AS number FROM part""",
    "measure_ranges": "SELECT CASE WHEN b = 0 THEN a::VARCHAR ELSE a || ['..', ':', '-'][a % 3 + 1] || (a + b) END AS given, a::INT AS first, (a + b)::INT AS last FROM range(1, 40) x(a), range(3) y(b)",
    "settings_documents": "SELECT 'level ' || (r_regionkey + 10) || '+' AS name, r_regionkey * 0.5::DOUBLE AS low, r_regionkey * 0.75::DOUBLE AS high FROM region UNION ALL SELECT n, v, v FROM (VALUES "
    + ", ".join(f"('{b}', {i + 0.5}::DOUBLE)" for i, b in enumerate(scoring.BASELINES)) + ") t(n, v)",
    "audio_sources": """SELECT p_partkey AS chart_id, CASE WHEN p_partkey % 2 = 0 THEN 'in/' || p_partkey || '/track.ogg' WHEN p_partkey % 3 = 0 THEN 'music/' || p_partkey || '/track.mp3' END AS audio_file,
  CASE WHEN p_partkey % 2 = 0 THEN 'ogg' WHEN p_partkey % 3 = 0 THEN 'mp3' END AS audio_format FROM part""",
    "dry_run": "SELECT count(*) AS rows, min(vec_id) AS first_key, max(vec_id) AS last_key, max(len(embedding)) AS dimension, count(DISTINCT len(embedding)) AS kinds FROM embeddings",
    "measure_csv": _K + """SELECT chart_id::VARCHAR AS chart_id, slot // 4 + 1 AS idx, printf('%.6f', (slot // 4) * 2.0) AS start_seconds, printf('%.6f', count(*) * 0.5) AS duration_seconds, CASE WHEN count(*) = 4 THEN 'measure_full' ELSE 'chart_end' END AS ended_by FROM k GROUP BY 1, 2, slot // 4""",
    "measure_texts": _K + f""", m AS (SELECT chart_id, slot // 4 + 1 AS idx, slot % 4 AS i, lane, event_type, {_TOKEN} AS token FROM k)
SELECT chart_id, idx, CASE WHEN idx = 1 THEN '(120)' ELSE '' END || '{{4}}' || string_agg(token || ',', '' ORDER BY i) AS text, coalesce(string_agg(i || ' ' || lane, ',' ORDER BY i) FILTER (event_type IN ('click', 'view', 'purchase')), '') AS all_lanes,
  coalesce(string_agg(i || ' ' || CASE WHEN event_type = 'purchase' THEN '' ELSE lane::VARCHAR END, ',' ORDER BY i) FILTER (event_type IN ('click', 'view', 'purchase')), '') AS hand_lanes,
  coalesce(string_agg(i || ' ' || CASE WHEN event_type = 'view' THEN '' ELSE lane::VARCHAR END, ',' ORDER BY i) FILTER (event_type IN ('click', 'view', 'purchase')), '') AS tap_lanes, count(*) FILTER (event_type = 'purchase') AS paths FROM m GROUP BY 1, 2""",
    "commented_charts": "SELECT p_partkey AS chart_id, p_size % 4 + 3 AS n, '1;2;' || repeat('3h[4:1];', (p_size % 4)::INT) || '4b' AS notes FROM part",
    "plain_numbers": "SELECT DISTINCT p_size, p_size::VARCHAR AS whole, CASE WHEN p_size % 4 = 0 THEN (p_size // 4)::VARCHAR ELSE regexp_replace(printf('%.2f', p_size / 4), '0+$', '') END AS quarter FROM part",
    "slide_lengths": """WITH b AS (SELECT i AS b FROM range(1, 9) t(i)), c AS (SELECT x.b AS p, y.b AS q, 2 * abs(sin(pi() * (y.b - x.b) / 8)) AS l FROM b x, b y)
SELECT '-' AS shape, p AS start, 0::BIGINT AS middle, q AS "end", round(l, 6) AS length FROM c""",
    "audio_rows": notation_queries.SQL["window_rows"].split("SELECT chart_id || ':' || s0")[0]
    + "SELECT chart_id || ':' || s0 || '-' || e AS key, chart_id || '.mp3' AS audio_file, round((s0 - 1) * 2.0::DOUBLE, 6) AS start_seconds, round(least(events, e * 4) * 0.5::DOUBLE, 6) AS end_seconds FROM k WHERE chart_id::INT % 2 = 0",
    "score_file": _CHAIN[: _CHAIN.index(",\ncut_edges AS")] + ", s AS (SELECT f.*, " + ", ".join(f"{v} AS {n}_score" for n, v in chart_queries._scores(chart_queries._GLOBAL).items())
    + ", (SELECT b.start_measure FROM burst b WHERE b.chart_id = f.chart_id) AS burst_start FROM features f, base)\nSELECT 't' || chart_id AS title, measure_count, total_notes::BIGINT AS total_notes, burst_note_count::BIGINT AS burst_note_count, burst_start AS burst_start_measure, round(duration_seconds, 6) AS duration_seconds, "
    + f"CASE {_order} END AS dominant_dimension, " + ", ".join(f"round({n}_score, 6) AS {n}_score" for n in stats.SCORES) + " FROM s",
    "steady_tiers": "WITH q AS (" + _STEADY + """),
t AS (SELECT label, CASE WHEN label = 'STEADY' THEN CASE WHEN chart_id % 5 = 0 THEN 'LOW' WHEN chart_id % 5 = 1 THEN 'HIGH' WHEN mean <= 4.03 THEN 'LOW' WHEN mean >= 7.97 THEN 'HIGH' ELSE 'MID' END END AS tier FROM q)
SELECT 'label ' || coalesce(tier || '_STEADY', label) AS name, count(*) AS n FROM t GROUP BY 1 UNION ALL SELECT 'tier ' || tier, count(*) FROM t WHERE tier IS NOT NULL GROUP BY 1""",
    "saved_model": "SELECT 8::INT AS components, 64::INT AS dimensions, true AS falling, count(*) AS same_vectors FROM embeddings",
    "frame_masks": "SELECT p_partkey, array_to_string(list_transform(range(p_size), lambda i: CASE WHEN i * 3 < p_size * 2 THEN '1' ELSE '0' END), '') AS mask FROM part",
    "charter_buckets": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '多人合作谱' WHEN s_suppkey % 4 > 0 THEN s_name ELSE '未署名' END AS bucket FROM supplier",
    "level_values": "SELECT p_partkey, (p_size % 18 + CASE WHEN p_partkey % 2 = 0 THEN 0.5 ELSE 0 END)::DOUBLE AS half, round((p_size % 18 + CASE WHEN p_partkey % 2 = 0 THEN 0.6 ELSE 0 END)::DOUBLE, 6) AS plus FROM part",
    "kind_targets": "SELECT p_brand, round_even(37.0::DOUBLE * count(*) / (SELECT count(*) FROM part), 0)::INT AS target FROM part GROUP BY 1",
    "nonzero_median": "SELECT o_custkey, coalesce(quantile_cont(o_orderkey % 17, 0.5) FILTER (o_orderkey % 3 > 0 AND o_orderkey % 17 > 0), -1)::DOUBLE AS median FROM orders GROUP BY 1",
    "marked_notes": """WITH s(shape, tap, hold, slide, touch, touch_hold, break_taps, each_groups) AS (VALUES (0, 1, 0, 0, 0, 0, 1, 0), (1, 1, 0, 0, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0, 1, 0), (3, 1, 0, 0, 0, 0, 0, 0), (4, 1, 0, 0, 0, 0, 0, 0), (5, 0, 1, 0, 0, 0, 0, 0), (6, 0, 1, 0, 0, 0, 0, 0),
  (7, 1, 0, 1, 0, 0, 0, 0), (8, 1, 0, 1, 0, 0, 0, 0), (9, 1, 0, 2, 0, 0, 0, 0), (10, 0, 0, 1, 0, 0, 0, 0), (11, 1, 0, 1, 0, 0, 0, 0), (12, 0, 0, 0, 1, 0, 0, 0), (13, 0, 0, 0, 1, 0, 0, 0), (14, 0, 0, 0, 1, 0, 0, 0), (15, 0, 0, 0, 0, 1, 0, 0),
  (16, 2, 0, 0, 0, 0, 0, 1), (17, 2, 0, 0, 0, 0, 1, 1), (18, 2, 0, 0, 0, 0, 0, 0), (19, 1, 0, 1, 0, 0, 0, 0)), n AS (SELECT p_partkey % 20 AS shape, count(*) AS n FROM part GROUP BY 1)
SELECT s.shape::BIGINT AS shape, tap::BIGINT AS tap, hold::BIGINT AS hold, slide::BIGINT AS slide, touch::BIGINT AS touch, touch_hold::BIGINT AS touch_hold, break_taps::BIGINT AS break_taps, each_groups::BIGINT AS each_groups, n FROM s JOIN n ON n.shape = s.shape""",
}
