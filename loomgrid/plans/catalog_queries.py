"""Queries of catalog, integrity, selection, vector and retrieval operators over the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ring, stats, text, vectors
from ..operators import charts as chart_ops
from ..operators import embedding, integrity, retrieval, selection
from . import fixtures
from .fixtures import sql, table


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _catalog(spark, sf_dir):
    """Customers as songs and orders as their charts."""
    songs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("song_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("genre"))
    charts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("song_id"), "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("content"), F.when(F.col("o_orderkey") % 2 == 0, "dx").otherwise("st").alias("kind"), (F.col("o_orderkey") % 2 + 5).alias("difficulty"))
    return charts, songs


def chart_catalog_join(spark, sf_dir):
    charts, songs = _catalog(spark, sf_dir)
    out = integrity.catalog(charts, songs)
    return out.select("o_orderkey", text.chart_id(F.col("song_id"), F.col("kind"), F.col("difficulty")).alias("chart_id"), text.chart_name(F.col("song_id"), F.col("kind"), F.col("difficulty"), F.col("title")).alias("chart_name"), F.coalesce("genre", F.lit("none")).alias("genre"))


def song_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    charts = p.select(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " [DX]").otherwise("")).alias("title"), F.col("p_brand").alias("artist"), F.concat((F.col("p_size") % 20).cast("string"), F.lit(". v")).alias("version"))
    return integrity.song_ids(charts).select(F.col("song_id").cast("bigint").alias("song_id"), "title_key", "artist_key", "version", "chart_count")


def chart_kinds(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    title = F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, " [DX]").when(F.col("p_partkey") % 7 == 0, " [ST]").otherwise(""))
    cabinet = F.when(F.col("p_partkey") % 11 == 0, "dx")
    version = F.when(F.col("p_partkey") % 13 != 0, F.concat((F.col("p_size") % 30).cast("string"), F.lit(".x")))
    return p.select("p_partkey", text.chart_kind(title, F.col("p_type"), cabinet, version).alias("kind"), text.version_number(version).cast("bigint").alias("version_no"))


def charter_categories(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey"), F.when(F.col("s_suppkey") % 9 == 0, "").otherwise(F.concat(F.lit("n"), (F.col("s_suppkey") % 8).cast("string"))).alias("charter"))
    aliases = spark.sql("SELECT * FROM VALUES ('n0', 'main0'), ('n1', 'main0'), ('n2', 'main2') AS t(alias, main)")
    credits = spark.sql("SELECT * FROM VALUES ('n3', array('n1', 'x／y')), ('n4', array('n2', 'n2')) AS t(credit, names)")
    unknown = spark.sql("SELECT * FROM VALUES ('n5') AS t(credit)")
    out = integrity.charter_category(s, aliases, credits, unknown)
    return out.select("s_suppkey", "charter_category", F.to_json("charter_names").alias("names"))


def key_integrity(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return integrity.compare_keys(c, o, "key")


def key_duplicates(spark, sf_dir):
    return integrity.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


def missing_patterns(spark, sf_dir):
    return integrity.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


def mapping_equality(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi"), F.max("l_suppkey").alias("supp"))
    return integrity.mapping_differences(li.select("l_orderkey", F.col("lo").alias("part"), "supp"), li.select("l_orderkey", F.col("hi").alias("part"), "supp"), "l_orderkey", "part", "supp")


def fk_containment(spark, sf_dir):
    inner = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k"), F.col("l_quantity").alias("start"), (F.col("l_quantity") + F.col("l_linenumber")).alias("end"))
    outer = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") * 0.2).alias("start"), (F.col("p_size") + 20.0).alias("end"))
    return integrity.containment(inner, outer, ["k"]).select("l_orderkey", "l_linenumber", "ok")


def record_join(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    patterns = e.select(F.concat(F.lit("k"), "vec_id").alias("key"), F.col("vec_id").alias("chart_id"), (F.col("vec_id") % 40).alias("song_id"), (F.col("vec_id") % 6).cast("int").alias("segment_id"), F.concat("vec_id", F.lit(":"), F.col("vec_id") % 6).alias("segment_key"), "vector")
    split = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chart_id"), (F.col("doc_id") % 40).alias("song_id"), (F.col("quality") + 5).alias("difficulty"), (F.col("doc_id") % 15 + 0.5).alias("level_value"))
    audio = d.select(F.concat(F.lit("k"), "doc_id").alias("key"), F.concat("source", F.lit(".mp3")).alias("audio_file"))
    segs = e.select(F.concat("vec_id", F.lit(":"), F.col("vec_id") % 6).alias("key"), *(((F.col("vec_id") * (i + 3)) % 201).cast("double").alias(f"{n}_score") for i, n in enumerate(stats.SCORES)))
    out = integrity.records(patterns, split, audio, segs)
    return out.select("key", "chart_id", "song_id", "segment_id", "difficulty", "difficulty_id", "audio_file", F.round(F.aggregate("numeric_conditions", F.lit(0.0), lambda s, x: s + x), 6).alias("conditions"), F.round(vectors.norm(F.col("teacher_vector")), 6).alias("length"))


def upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    u = s.where("s_acctbal < 0").select("s_suppkey", F.upper("s_name").alias("s_name"), (F.col("s_nationkey") * 2).alias("level")).union(spark.sql("SELECT -1L, 'none', 0"))
    return integrity.upsert(s.select("s_suppkey", "s_name", "s_nationkey"), u, "s_suppkey")


def split_leakage(spark, sf_dir):
    d = _splits(spark, sf_dir)
    return integrity.leakage(d, "song_id", "split")


def _splits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("doc_id") % 211).alias("song_id"))
    return d.withColumn("split", F.when(F.col("song_id") % 10 < 6, "train").when(F.col("song_id") % 10 < 8, "validation").when(F.col("doc_id") % 29 == 0, "train").otherwise("test"))


def split_summary(spark, sf_dir):
    return selection.split_summary(_splits(spark, sf_dir), "split", "song_id", ["lang", "source"])


def pp_spread(spark, sf_dir):
    return rounded(selection.share_spread(_splits(spark, sf_dir), "split", ["lang", "source"]), "spread")


def exclude_low(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chart_id"), F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("version_no"), (F.col("n_chars") % 160 / 10.0).alias("level_value"))
    return selection.exclude_lowest(d, 150, tie=F.col("chart_id")).select("chart_id")


def sample_records(spark, sf_dir):
    return selection.sample(table(spark, sf_dir, "documents").select("doc_id"), 100, "doc_id", 20260715)


def disjoint_batches(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("user_id").alias("song_id"))
    out = selection.disjoint_batches(e, 16, order=F.col("key"))
    return out.select("key", "song_id", F.col("round").cast("bigint").alias("round"), F.col("batch").cast("bigint").alias("batch"))


def greedy_select(spark, sf_dir):
    """What a selection of 100 charts has: as many different charts, and every value of its categories."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chart_id"), F.col("lang").alias("kind"), "source", (F.col("n_chars") % 17).alias("level"))
    out = selection.select_covering(d, 100, ["source", "level"])
    return out.select("chart_id").join(d, "chart_id").agg(F.count("*").alias("charts"), F.countDistinct("chart_id").alias("different"), F.countDistinct("source").alias("sources"), F.countDistinct("level").alias("levels"))


def disjoint_split(spark, sf_dir):
    """Sizes of splits that share no song, and the songs that they share."""
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chart_id"), (F.col("doc_id") % 140).alias("song_id"), "quality", "toxic")
    n = d.count()
    sizes = {"train": n - 2 * (n // 5), "validation": n // 5, "test": n // 5}
    out = selection.split_disjoint(d, sizes, ["quality", "toxic"])
    return selection.check_split(out.join(d, "chart_id"), sizes).select("split", "size", F.col("wanted").cast("bigint").alias("wanted"), F.col("shared_songs").cast("bigint").alias("shared_songs"))


def vector_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.unit(F.col("embedding"))).alias("pos", "value"))
    return e.select("vec_id", "pos", F.round(F.col("value").cast("double"), 6).alias("value"))


def cosine_pairs(spark, sf_dir):
    v = fixtures.vectors(spark, sf_dir)
    return v.select("id", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


def retrieval_ranks(spark, sf_dir):
    v = fixtures.vectors(spark, sf_dir)
    return retrieval.ranks(v.select("id", F.col("b").alias("vector")), v.select("id", F.col("a").alias("vector")))


def rank_metrics(spark, sf_dir):
    return rounded(retrieval.rank_metrics(retrieval_ranks(spark, sf_dir)), "recall_at_1", "recall_at_5", "recall_at_10", "mrr")


def shifted_cosine(spark, sf_dir):
    return rounded(retrieval.shifted_cosine(fixtures.vectors(spark, sf_dir), "id"), "cosine", "shifted")


def stat_pooling(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.posexplode("embedding").alias("pos", "v"))
    frames = e.select((F.col("vec_id") / 10).cast("bigint").alias("id"), "pos", F.col("v").cast("double").alias("value"), (F.col("vec_id") % 3 != 0).alias("mask"))
    return rounded(retrieval.statistical_pooling(frames, ["id", "pos"]), "mean", "most", "deviation")


def infonce_loss(spark, sf_dir):
    v = fixtures.vectors(spark, sf_dir).select("id", F.floor(F.col("id") / 32).alias("batch"), vectors.unit(F.col("a")).alias("a"), vectors.unit(F.col("b")).alias("b"))
    return rounded(retrieval.contrastive_loss(v), "contrastive", "distance", "loss")


def signed_log_block(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    both = F.arrays_zip(vectors.signed_log_block(F.col("x")).alias("signed"), vectors.log_block(F.col("x")).alias("plain"))
    e = e.select("vec_id", F.posexplode(both).alias("pos", "z"))
    return e.select("vec_id", "pos", F.round(F.get(F.array("z.*"), F.lit(0)), 6).alias("signed"), F.round(F.get(F.array("z.*"), F.lit(1)), 6).alias("plain"))


def svd_singular_values(spark, sf_dir):
    """What all singular values add up to: the squares to the sum of all squares, their fourth powers to that of the products of columns; and how many there are."""
    _, values, right = embedding.svd(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    squares = [float(v) ** 2 for v in values]
    apart = float(abs(right.T @ right - np.eye(len(values))).max())
    return spark.createDataFrame([(len(values), round(sum(squares), 3), round(sum(x * x for x in squares), 1), apart < 1e-9)], "components int, squares double, fourth_powers double, orthonormal boolean")


def svd_vectors(spark, sf_dir):
    """Cosines of neighbours after a decomposition of full rank, which keeps all angles."""
    out, _, _ = embedding.svd(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    other = out.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    cosine = F.aggregate(F.zip_with("embedding", "other", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return out.join(other, "vec_id").select("vec_id", F.round(cosine, 3).alias("cosine"))


def sparsity(spark, sf_dir):
    return rounded(embedding.sparsity(table(spark, sf_dir, "embeddings"), "embedding"), "share")


def sha1_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("hash"), F.octet_length("text").cast("bigint").alias("size"))


def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"), text.audio_format(F.concat("url", F.lit("/a.MP3"))).alias("format"))


def large_dividers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("(120){"), F.col("p_size") * 20, F.lit("}1,{#2.5}2,{"), F.col("p_size") * 31, F.lit(".5}3,{4}4,{"), F.col("p_size") * 20, F.lit("}5,E")).alias("content"))
    out = p.select("p_partkey", text.large_dividers(F.col("content"), 384).alias("d")).where(F.size("d") > 0)
    return out.select("p_partkey", F.size("d").cast("bigint").alias("n"), F.array_max("d").alias("largest"))


def chart_fields(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("&title= "), "p_name", F.lit("\n&lv_5="), "p_size", F.lit("\nstray line\n&lv_5="), F.col("p_size") + 1, F.lit("\n&first="), F.col("p_partkey") % 4, F.lit("\n&inote_5=(120){4}1,\n2,E\n")).alias("doc"))
    return chart_ops.fields(p, "p_partkey", "doc")


def first_offsets(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("&title=a\n&first="), F.when(F.col("p_partkey") % 3 == 0, "").otherwise((F.col("p_partkey") % 4).cast("string")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("\n&first_5="), F.col("p_size") / 8)).otherwise("")).alias("doc"))
    return chart_ops.first_seconds(chart_ops.fields(p, "p_partkey", "doc"), "p_partkey", ["5", "6"])


def ring_distances(spark, sf_dir):
    rows = spark.range(64).select((F.col("id") % 8 + 1).cast("int").alias("a"), (F.floor(F.col("id") / 8) + 1).cast("int").alias("b"))
    return rows.select("a", "b", ring.ring_distance(F.col("a"), F.col("b")).alias("distance"), ring.direction(F.col("a"), F.col("b")).alias("direction"), ring.moment_distance(F.array("a", "b"), F.array(F.lit(1), F.lit(6))).alias("moment_distance"))


def running_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_discount").alias("loss"), F.avg("l_tax").alias("cosine"))
    return retrieval.weighted_means(li, ["loss", "cosine"]).select(F.round("loss", 9).alias("loss"), F.round("cosine", 9).alias("cosine"))


_VECTORS = """WITH c AS (SELECT count(*) AS n FROM embeddings),
j AS (SELECT e.vec_id AS id, e.embedding::DOUBLE[] AS a, o.embedding::DOUBLE[] AS o FROM embeddings e, c JOIN embeddings o ON o.vec_id = (e.vec_id + 1) % c.n),
v AS (SELECT id, a, list_transform(list_zip(a, o), lambda z: z[1] + z[2] * 0.25::DOUBLE) AS b FROM j)
"""
_SPLITS = "WITH d AS (SELECT doc_id, lang, source, doc_id % 211 AS song_id FROM documents), s AS (SELECT *, CASE WHEN song_id % 10 < 6 THEN 'train' WHEN song_id % 10 < 8 THEN 'validation' WHEN doc_id % 29 = 0 THEN 'train' ELSE 'test' END AS split FROM d)\n"
def dataset_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chart_id"), F.col("l_suppkey").alias("song_id"), F.col("l_linenumber").alias("difficulty"), (F.col("l_linenumber") % 5).alias("segment_id"), F.col("l_quantity").alias("level_value"))
    out = selection.dataset_summary(li)
    return out.withColumns({"difficulty_counts": F.to_json("difficulty_counts"), "segment_id_counts": F.to_json("segment_id_counts")})


def category_totals(spark, sf_dir):
    return selection.category_totals(table(spark, sf_dir, "part"), ["p_brand", "p_size"])


def divider_summary(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chart_id"), (F.col("p_partkey") % 50).alias("song_id"), F.concat(F.lit("{"), F.col("p_size") * 20, F.lit("}1,E")).alias("content"))
    return selection.divider_summary(p, 384)


def greedy_splits(spark, sf_dir):
    """Sizes of splits by categories, and the charts that are in several."""
    d = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chart_id"), F.col("quality").alias("kind"), (F.col("doc_id") % 7).alias("version"), (F.col("doc_id") % 3).alias("genre"))
    n = d.count()
    out = selection.assign_splits(d, {"train": n - 2 * (n // 6), "validation": n // 6, "test": n // 6}, ["version", "genre"])
    again = F.count("*").over(Window.partitionBy("chart_id"))
    return out.withColumn("again", again).groupBy("split").agg(F.count("*").alias("size"), F.count_if(F.col("again") > 1).alias("repeated"), F.countDistinct("chart_id").alias("different"))


def table_check(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    chunk = e.select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vector"))
    index = e.groupBy((F.col("vec_id") % 10).alias("chart_id")).agg(F.count("*").alias("chunk_count"))
    seg = spark.range(50).select((F.col("id") / 5).cast("bigint").alias("chart_id"), *((F.col("id") * (i + 1)).cast("double").alias(f"{n}_score") for i, n in enumerate(stats.SCORES)))
    return integrity.table_check(chunk, index, seg, 64)


SQL = {
    "dataset_summary": """WITH l AS (SELECT l_linenumber AS d, l_linenumber % 5 AS g FROM lineitem), a AS (SELECT d, count(*) AS n FROM l GROUP BY 1), b AS (SELECT g, count(*) AS n FROM l GROUP BY 1)
SELECT count(*) AS record_count, count(DISTINCT l_orderkey) AS chart_count, count(DISTINCT l_suppkey) AS song_count, min(l_quantity) AS minimum_level, max(l_quantity) AS maximum_level,
  (SELECT '{' || string_agg('"' || d || '":' || n, ',' ORDER BY d) || '}' FROM a) AS difficulty_counts, (SELECT '{' || string_agg('"' || g || '":' || n, ',' ORDER BY g) || '}' FROM b) AS segment_id_counts FROM lineitem""",
    "category_totals": "SELECT 'p_brand' AS feature, p_brand AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY 2",
    "divider_summary": "SELECT count(DISTINCT p_partkey % 50) AS songs, count(*) AS charts, max(p_size * 20)::DOUBLE AS largest FROM part WHERE p_size * 20 > 384",
    "table_check": """WITH s AS (SELECT i // 5 AS c, max(i * 6) > 200 AS b, count(*) FILTER (i * 6 > 200) AS k FROM range(50) t(i) GROUP BY 1)
SELECT count(*) AS rows, count(*) AS keys, 0::BIGINT AS bad_vectors, count(*) AS indexed, 0::BIGINT AS bad_charts, (SELECT sum(k) FROM s)::BIGINT AS bad_scores, false AS ok FROM embeddings""",
    "chart_catalog_join": """SELECT o_orderkey, o_custkey || ':' || CASE WHEN o_orderkey % 2 = 0 THEN 'DX' ELSE 'ST' END || ':' || (o_orderkey % 2 + 5) AS chart_id,
  lpad(o_custkey::VARCHAR, 5, '0') || '_' || CASE WHEN o_orderkey % 2 = 0 THEN 'dx' ELSE 'st' END || '_' || (o_orderkey % 2 + 5) || '_' || regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS chart_name,
  coalesce(c_mktsegment, 'none') AS genre FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0 AND trim(o_orderpriority) <> ''""",
    "song_ids": """WITH c AS (SELECT trim(regexp_replace(trim(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' [DX]' ELSE '' END), '\\s+\\[(DX|ST)\\]$', '')) AS title_key, lower(regexp_replace(trim(p_brand), '[\\s+&・/／]+', '', 'g')) AS artist_key, p_size % 20 AS no, (p_size % 20) || '. v' AS version FROM part),
g AS (SELECT title_key, artist_key, min(no) AS no, arg_min(version, no) AS version, count(*) AS chart_count FROM c GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY no, version, title_key, artist_key) AS song_id, title_key, artist_key, version, chart_count FROM g""",
    "chart_kinds": """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 5 <> 0 THEN 'ST' WHEN p_partkey % 5 = 0 THEN 'DX' WHEN p_partkey % 11 = 0 THEN 'DX' WHEN p_partkey % 13 = 0 OR p_size % 30 >= 14 THEN 'DX' ELSE 'ST' END AS kind,
  CASE WHEN p_partkey % 13 = 0 THEN 9999 ELSE p_size % 30 END::BIGINT AS version_no FROM part""",
    "charter_categories": """SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 OR s_suppkey % 8 <= 2 THEN '个人谱师' WHEN s_suppkey % 8 <= 5 THEN '多人合作谱' ELSE '未识别' END AS charter_category,
  CASE WHEN s_suppkey % 9 = 0 THEN '["未署名"]' ELSE list_value('["main0"]', '["main0"]', '["main2"]', '["main0","x"]', '["main2","main2"]', '["n5"]', '["n6"]', '["n7"]')[s_suppkey % 8 + 1] END AS names FROM supplier""",
    "key_integrity": """WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT count(*) AS n_keys, count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right, min(a.k::VARCHAR) FILTER (b.k IS NULL) AS left_example, min(b.k::VARCHAR) FILTER (a.k IS NULL) AS right_example FROM a FULL JOIN b ON a.k = b.k""",
    "key_duplicates": 'SELECT l_orderkey, l_linenumber, count(*) AS "count" FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1',
    "missing_patterns": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "mapping_equality": "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_partkey) <> max(l_partkey)",
    "fk_containment": """SELECT l_orderkey, l_linenumber, coalesce(p_size * 0.2 <= l_quantity AND l_quantity + l_linenumber <= p_size + 20.0, false) AS ok
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""",
    "record_join": """WITH x AS (SELECT e.vec_id, l.quality, d.source, list_transform(range(6), lambda i: (e.vec_id * (i + 3)) % 201) AS s FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 6 <= 4)
SELECT 'k' || vec_id AS key, vec_id AS chart_id, vec_id % 40 AS song_id, (vec_id % 6)::INT AS segment_id, quality + 5 AS difficulty, quality AS difficulty_id, source || '.mp3' AS audio_file,
  round(least(1.5, (vec_id % 15 + 0.5::DOUBLE) / 15) + list_sum(list_transform(s, lambda z: z / 200.0::DOUBLE)), 6) AS conditions, 1.0::DOUBLE AS length FROM x""",
    "upsert": "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN upper(s_name) ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_acctbal < 0 THEN s_nationkey * 2 END AS level FROM supplier",
    "split_leakage": _SPLITS + "SELECT song_id, count(DISTINCT split) AS splits FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "split_summary": _SPLITS + "SELECT split, count(*) AS n_charts, count(DISTINCT song_id) AS n_songs, count(DISTINCT lang) AS n_lang, count(DISTINCT source) AS n_source FROM s GROUP BY 1",
    "pp_spread": _SPLITS
    + """, z AS (SELECT split, count(*) AS size FROM s GROUP BY 1), l AS (SELECT split, 'lang' AS feature, lang AS value FROM s UNION ALL SELECT split, 'source', source FROM s),
c AS (SELECT feature, value, split, count(*) AS n FROM l GROUP BY ALL), u AS (SELECT DISTINCT feature, value FROM l)
SELECT u.feature, u.value, round(max(100 * coalesce(c.n, 0) / z.size) - min(100 * coalesce(c.n, 0) / z.size), 6) AS spread FROM u CROSS JOIN z LEFT JOIN c ON c.feature = u.feature AND c.value IS NOT DISTINCT FROM u.value AND c.split = z.split GROUP BY 1, 2""",
    "exclude_low": "WITH d AS (SELECT doc_id AS chart_id, regexp_extract(source, '(\\d+)', 1)::INT AS v, n_chars % 160 / 10.0::DOUBLE AS l FROM documents) SELECT chart_id FROM d WHERE l < 13 QUALIFY row_number() OVER (ORDER BY v, l, chart_id) > 150",
    "disjoint_batches": """WITH r AS (SELECT event_id AS key, user_id AS song_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS round FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY round) AS c FROM r) SELECT key, song_id, round, i // 16 AS batch FROM n WHERE i < c // 16 * 16""",
    "vector_normalize": "WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS a, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings) SELECT vec_id, unnest(range(len(a)))::INT AS pos, round(unnest(a) / n, 6) AS value FROM u",
    "cosine_pairs": _VECTORS + "SELECT id, round(list_cosine_similarity(a, b), 6) AS cosine FROM v",
    "retrieval_ranks": _VECTORS + ", t AS (SELECT q.id, list_inner_product(q.b, q.a) AS own FROM v q) SELECT q.id, 1 + count(*) FILTER (list_inner_product(q.b, c.a) > t.own + 1e-9) AS rank FROM v q JOIN t ON t.id = q.id CROSS JOIN v c GROUP BY 1",
    "shifted_cosine": _VECTORS + ", w AS (SELECT id, a, b, coalesce(lag(b) OVER (ORDER BY id), last_value(b) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS p FROM v) SELECT id, round(list_cosine_similarity(a, b), 6) AS cosine, round(list_cosine_similarity(a, p), 6) AS shifted FROM w",
    "stat_pooling": """WITH f AS (SELECT vec_id // 10 AS id, vec_id % 3 <> 0 AS mask, unnest(embedding::DOUBLE[]) AS value, unnest(range(64))::INT AS pos FROM embeddings)
SELECT id, pos, round(avg(value), 6) AS mean, round(max(value), 6) AS most, round(sqrt(var_pop(value) + 1e-6), 6) AS deviation FROM f WHERE mask GROUP BY 1, 2""",
    "infonce_loss": _VECTORS
    + """, u AS (SELECT id, id // 32 AS batch, list_transform(a, lambda x: x / sqrt(list_inner_product(a, a))) AS a, list_transform(b, lambda x: x / sqrt(list_inner_product(b, b))) AS b FROM v),
l AS (SELECT p.batch, p.id AS i, q.id AS j, list_inner_product(p.a, q.b) / 0.07 AS x FROM u p JOIN u q ON p.batch = q.batch),
f AS (SELECT i, max(x) AS m FROM l GROUP BY 1), g AS (SELECT j, max(x) AS m FROM l GROUP BY 1),
a1 AS (SELECT avg(z) AS v FROM (SELECT l.i, ln(sum(exp(x - m))) + max(m) - sum(CASE WHEN l.i = l.j THEN x ELSE 0 END) AS z FROM l JOIN f ON f.i = l.i GROUP BY 1)),
a2 AS (SELECT avg(z) AS v FROM (SELECT l.j, ln(sum(exp(x - m))) + max(m) - sum(CASE WHEN l.i = l.j THEN x ELSE 0 END) AS z FROM l JOIN g ON g.j = l.j GROUP BY 1)),
dd AS (SELECT 1 - avg(list_inner_product(a, b)) AS d FROM u)
SELECT round((a1.v + a2.v) / 2, 6) AS contrastive, round(d, 6) AS distance, round((a1.v + a2.v) / 2 + 0.2 * d, 6) AS loss FROM a1, a2, dd""",
    "signed_log_block": """WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: sign(x) * ln(1 + abs(x))) AS s, list_transform(embedding::DOUBLE[], lambda x: ln(1 + greatest(x, 0))) AS p FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(s, s)) AS ns, sqrt(list_inner_product(p, p)) AS np FROM e)
SELECT vec_id, unnest(range(len(s)))::INT AS pos, round(unnest(s) / ns, 6) AS signed, round(unnest(p) / np, 6) AS plain FROM n""",
    "sample_records": "SELECT doc_id FROM documents ORDER BY md5('20260715:' || doc_id), doc_id LIMIT 100",
    "greedy_select": "SELECT 100::BIGINT AS charts, 100::BIGINT AS different, count(DISTINCT source) AS sources, count(DISTINCT n_chars % 17) AS levels FROM documents",
    "disjoint_split": "WITH c AS (SELECT count(*) AS n FROM labels) SELECT s AS split, CASE WHEN s = 'train' THEN n - 2 * (n // 5) ELSE n // 5 END AS size, CASE WHEN s = 'train' THEN n - 2 * (n // 5) ELSE n // 5 END AS wanted, 0::BIGINT AS shared_songs FROM c, (VALUES ('train'), ('validation'), ('test')) t(s)",
    "greedy_splits": "WITH c AS (SELECT count(*) AS n FROM labels) SELECT s AS split, CASE WHEN s = 'train' THEN n - 2 * (n // 6) ELSE n // 6 END AS size, 0::BIGINT AS repeated, CASE WHEN s = 'train' THEN n - 2 * (n // 6) ELSE n // 6 END AS different FROM c, (VALUES ('train'), ('validation'), ('test')) t(s)",
    "svd_singular_values": """WITH x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
g AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY 1, 2)
SELECT 64::INT AS components, round(sum(v) FILTER (i = j), 3) AS squares, round(sum(v * v), 1) AS fourth_powers, true AS orthonormal FROM g""",
    "svd_vectors": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 3) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "ring_distances": """WITH p AS (SELECT i % 8 + 1 AS a, i // 8 + 1 AS b FROM range(64) t(i)),
o AS (SELECT *, least(a, b) AS x, greatest(a, b) AS y FROM p),
d AS (SELECT *, least((x + 7) % 8, (9 - x) % 8) AS x1, least((x + 2) % 8, (14 - x) % 8) AS x6, least((y + 7) % 8, (9 - y) % 8) AS y1, least((y + 2) % 8, (14 - y) % 8) AS y6 FROM o),
n AS (SELECT *, least(greatest(x1, y6), greatest(x6, y1)) AS near, CASE WHEN x = y THEN x::DOUBLE WHEN y - x <= 4 THEN (x + y) / 2 ELSE (x + 8 + y) / 2 END AS center FROM d)
SELECT a::INT AS a, b::INT AS b, least((a - b + 8) % 8, (b - a + 8) % 8)::DOUBLE AS distance, CASE WHEN a = b THEN 'same' WHEN (b - a + 8) % 8 = 4 THEN 'opposite' WHEN (b - a + 8) % 8 < 4 THEN 'cw' ELSE 'ccw' END AS direction,
  CASE WHEN near <= 1 THEN near::DOUBLE ELSE abs(center - 7.5) END AS moment_distance FROM n""",
    "sparsity": "SELECT count(*) AS rows, sum(len(list_filter(embedding, lambda x: x <> 0)))::BIGINT AS nonzero, round(sum(len(list_filter(embedding, lambda x: x <> 0))) / sum(len(embedding)), 6) AS share FROM embeddings",
    "sha1_keys": "SELECT doc_id, sha1(coalesce(text, '')) AS hash, strlen(text)::BIGINT AS size FROM documents",
    "safe_names": "SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS name, 'mp3' AS format FROM pages",
    "large_dividers": """WITH d AS (SELECT p_partkey, list_filter([p_size * 20.0, p_size * 31 + 0.5], lambda x: x > 384) AS l FROM part)
SELECT p_partkey, len(l) AS n, list_max(l)::DOUBLE AS largest FROM d WHERE len(l) > 0""",
    "chart_fields": """SELECT p_partkey, unnest(['title', 'lv_5', 'first', 'inote_5']) AS field, unnest([trim(p_name), (p_size + 1)::VARCHAR, (p_partkey % 4)::VARCHAR, '(120){4}1,' || chr(10) || '2,E']) AS value FROM part""",
    "first_offsets": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 4)::DOUBLE END AS song, CASE WHEN p_partkey % 2 = 0 THEN p_size / 8 END AS own FROM part)
SELECT p_partkey, '5' AS difficulty, coalesce(own, song, 0)::DOUBLE AS first_seconds, CASE WHEN own IS NOT NULL THEN 'first_5' WHEN song IS NOT NULL THEN 'first' ELSE 'default' END AS origin FROM p
UNION ALL SELECT p_partkey, '6', coalesce(song, 0)::DOUBLE, CASE WHEN song IS NOT NULL THEN 'first' ELSE 'default' END FROM p""",
    "running_metrics": "SELECT round(avg(l_discount), 9) AS loss, round(avg(l_tax), 9) AS cosine FROM lineitem",
}
SQL["rank_metrics"] = (
    SQL["retrieval_ranks"].replace(" SELECT q.id, 1 + count", " , r AS (SELECT q.id, 1 + count")
    + ") SELECT count(*) AS n, round(avg((rank <= 1)::INT), 6) AS recall_at_1, round(avg((rank <= 5)::INT), 6) AS recall_at_5, round(avg((rank <= 10)::INT), 6) AS recall_at_10, round(avg(1 / rank), 6) AS mrr, quantile_disc(rank, 0.5) AS median_rank FROM r"
)
QUERIES = (
    chart_catalog_join, song_ids, chart_kinds, charter_categories, key_integrity, key_duplicates, missing_patterns, mapping_equality, fk_containment, record_join, upsert, split_leakage, split_summary, pp_spread,
    exclude_low, sample_records, disjoint_batches, greedy_select, disjoint_split, vector_normalize, cosine_pairs, retrieval_ranks, rank_metrics, shifted_cosine, stat_pooling, infonce_loss, signed_log_block,
    svd_singular_values, svd_vectors, sparsity, sha1_keys, safe_names, large_dividers, chart_fields, first_offsets, ring_distances, running_metrics, dataset_summary, category_totals, divider_summary,
    greedy_splits, table_check,
)
