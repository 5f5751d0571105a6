"""The queries of this subpackage for the driver, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprint, language_id, license_scan, near_dedup, packing, quality, secret_scan, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.encode(_table(spark, sf_dir, "documents"), tokenizer_path(), decoded=True)
    return tokens.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.document_token_counts(_table(spark, sf_dir, "documents"), tokenizer_path(), 50256)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("found")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*secret_scan.BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in secret_scan.BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(_table(spark, sf_dir, "documents"), words=3, percent=85)


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's placements by document: tokens and pieces, and whether all of its bins hold what they may: sizes are the smallest that do, and pieces neither overlap nor leave gaps."""
    placed = op1_best_fit_packing(spark, sf_dir)
    sizes = F.array(*map(F.lit, packing.SIZES))
    bins = placed.where("bin_id >= 0").groupBy("bin_id").agg(F.sum("n_tokens").alias("used"), F.max(F.col("bin_offset") + F.col("n_tokens")).alias("end"), F.min("bin_offset").alias("first"), F.max("bin_size").alias("most"), F.min("bin_size").alias("least"))
    smallest = F.array_min(F.filter(sizes, lambda x: x >= F.col("used")))
    fits = (F.col("used") == F.col("end")) & (F.col("first") == 0) & (F.col("most") == F.col("least")) & (F.col("most") == smallest)
    rows = placed.join(bins.select("bin_id", fits.alias("fits")), "bin_id", "left")
    return rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n_words"), F.count("*").alias("pieces"), F.min(F.coalesce("fits", F.col("n_tokens") == 0)).alias("fits"))


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of what op2's ids decode to."""
    return op2_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def token_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether op5's documents stand in their files one after the other, with a separator between."""
    rows = op5_token_counts(spark, sf_dir)
    before = F.lag(F.col("first_token") + F.col("n_tokens") + 1).over(Window.partitionBy("file").orderBy("doc_index"))
    return rows.select("doc_id", (F.col("first_token") == F.coalesce(before, F.lit(0))).alias("in_place"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edited texts that op6 fingerprints."""
    return op6_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    facts = (packed_documents, round_trip, token_places, edited_texts)
    return {f.__name__: f for f in facts} | {f.__name__: f for f in (op1_best_fit_packing, op2_bpe, op3_language_id, op4_exact_dedup, op5_token_counts, op6_fingerprints, op7_quality, op8_license, op9_secrets, op10_near_dedup)}


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express: the others are tested against libraries, brute force or held-out labels."""
    return {"op4_exact_dedup": OP4_SQL, "op8_license": op8_sql(), "op9_secrets": op9_sql(), "op10_near_dedup": OP10_SQL} | FACTS


FACTS = {
    "packed_documents": r"""WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents)
SELECT doc_id, n::BIGINT AS n_words, greatest(1, ceil(n / 8192))::BIGINT AS pieces, true AS fits FROM d""",
    "round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "token_places": "SELECT doc_id, true AS in_place FROM documents",
    "edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS after FROM documents WINDOW w AS (ORDER BY doc_id DESC))
SELECT doc_id, n AS n_chars, sha256(left(t, n - n // 3) || left(after, n // 3)) AS edited_sha256 FROM d""",
}

OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id
  FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.doc_id),
low AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.sh) AS n_shingles, low.component_id, low.component_id = s.doc_id AS kept FROM s JOIN low ON low.doc_id = s.doc_id
"""


def _list(values) -> str:
    quoted = [f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    return "[" + ", ".join(quoted) + "]"


def op8_sql() -> str:
    """Base phrases and templates word by word."""
    rows = ", ".join(f"('{label}', {_list(t.split())}, {_list(rare)}, ' {phrase} ')" for (label, t, phrase), rare in zip(license_scan.TEMPLATES, license_scan.rare_words(), strict=True))
    base = ", ".join(f"('{label}', {_list(p.split())}, ' {p} ')" for p, label in license_scan.BASE)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM d),
b(label, p, phrase) AS (VALUES {base}),
bp AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(p)] = p)) AS i FROM x JOIN b ON contains(line, phrase)),
ba AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS labels FROM bp GROUP BY 1),
t(label, words, rare, phrase) AS (VALUES {rows}),
c AS (SELECT doc_id, label, w, words, list_filter(rare, lambda r: list_contains(w, r))[1:{license_scan.LOOKED_UP}] AS rare FROM x JOIN t ON contains(line, phrase)),
p AS (SELECT *, list_filter(range(len(words)), lambda q: list_contains(rare, words[q + 1])) AS places FROM c),
o AS (SELECT doc_id, label, w, words, places, unnest(range(1 - len(words), len(w))) AS o FROM p),
r AS (SELECT * FROM o WHERE list_sum(list_transform(places, lambda q: CASE WHEN o + q >= 0 AND w[o + q + 1] = words[q + 1] THEN 1 ELSE 0 END)) >= 2),
m AS (SELECT doc_id, label, len(words) AS n, list_sum(list_transform(range(len(words)), lambda q: CASE WHEN o + q >= 0 AND w[o + q + 1] = words[q + 1] THEN 1 ELSE 0 END)) AS hits FROM r),
f AS (SELECT doc_id, max(hits / n) AS score, list_distinct(list(label)) AS labels FROM m WHERE hits / n >= {license_scan.IN_PLACE} GROUP BY 1)
SELECT x.doc_id, len(x.w) AS n_words, coalesce(ba.n_base, 0) AS n_base, ba.first_word, ba.last_word,
       coalesce(array_to_string(list_sort(ba.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(ba.labels, []), coalesce(f.labels, [])))), ','), '') AS labels, coalesce(f.score, 0) AS score
FROM x LEFT JOIN ba ON ba.doc_id = x.doc_id LEFT JOIN f ON f.doc_id = x.doc_id
"""


def op9_sql() -> str:
    """Matches of each kind in order; their places follow from the lengths of what stands between them."""
    parts = []
    for k, rule in enumerate(secret_scan.RULES):
        pattern = rule.pattern.replace("'", "''")
        if rule.fold:  # letters outside brackets of the keyword part, in either case but only of ASCII
            head, tail = secret_scan._KEY, rule.pattern.removeprefix(secret_scan._KEY)
            words = head[: head.index(")")]
            pattern = ("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words) + head[head.index(")") :] + tail).replace("'", "''")
        parts.append(f"SELECT {k} AS k, '{rule.kind}' AS kind, doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS p FROM d")
    keep = "CASE kind WHEN 'assign' THEN length(regexp_replace(s, '^[^:=]*[:=]\\x20*[\"'']?', '')) >= 6 WHEN 'github' THEN length(s) >= 40 WHEN 'slack' THEN length(s) >= 15 WHEN 'jwt' THEN regexp_full_match(s, '.{11,}[.].{11,}[.].{8,}') ELSE true END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({" UNION ALL ".join(parts)}),
e AS (SELECT k, kind, doc_id, m, p, unnest(range(1, len(m) + 1)) AS i FROM a WHERE len(m) > 0),
r AS (SELECT k, kind, doc_id, m[i] AS s, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a FROM e),
f AS (SELECT k, kind, doc_id, a::BIGINT AS a, (a + length(s))::BIGINT AS b FROM r WHERE {keep}),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3), '') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
