"""Exact deduplication by skew-safe combining; DataFrame functions only.

Texts are equal when they are identical without white space. The few digests that hold a large
share of the rows are found by a bounded frequent-items sketch. Rows are then combined in three
steps, each of which groups by the digest and the full normalised text, so that equal digests of
different texts are never merged:

1. locally: the partial aggregation of each map task leaves one row for each text;
2. by salted digest group: rows of heavy digests are dealt over SALTS groups, all others have one;
3. globally: the winners of the salts of heavy digests are combined.

Only step 2 moves whole texts. Rows then find their group by the digest alone, rows of hot digests dealt
over salts; if the digests of two different texts ever collide, by digest and full text.

Defined cases: a null text counts as empty; of equal texts the row with the most code points of
the original text stays, then the smallest id (a null id comes last); repeated rows are members of
their group like all others; texts are compared whole, however long; an empty table gives no rows; other
columns are not used, whatever their names, and `deduplicate` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, settle, skewed_join, small

SALTS = 64
#: Items that the sketch tracks and returns: both bound what reaches the driver. A digest of more than a few thousandths of the rows is always among them.
HEAVY, TRACKED = 256, 4096


def _whole(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def normalised(text: Column) -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _rank(chars: Column, key: Column) -> Column:
    """One decimal that is larger for more code points, then for a smaller id; the largest id takes 1, smaller ones more, and null 0."""
    back = F.coalesce(_whole(2**63) - key.cast("decimal(19,0)"), _whole(0))
    return (chars.cast("decimal(10,0)") * _whole(2**65) + back).cast("decimal(38,0)")


def _key(rank: Column) -> Column:
    back = rank % _whole(2**65)
    return F.when(back > 0, (_whole(2**63) - back).cast("bigint"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: key, keep_id (the key of the row that stays), group_size, kept, digest of the normalised text.

    `digest` maps the normalised text to a string; any function of it gives right groups."""
    base = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.char_length(F.col(text)), F.lit(0)).alias("chars"), normalised(F.col(text)).alias("norm"))
    base = base.withColumn("digest", digest(F.col("norm")))
    slim = settle(base.select("key", "chars", "digest"), "digests")

    sketch = slim.agg(F.expr(f"approx_top_k(digest, {HEAVY}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
    # a digest spread thinner than this is combined well enough by the map tasks
    heavy = [x["item"] for x in sketch["top"] or () if x["item"] is not None and x["count"] > max(64, sketch["n"] // TRACKED)]
    hot = F.col("digest").isin(heavy) if heavy else F.lit(False)

    ranked = base.select("digest", "norm", F.pmod(F.xxhash64("key", "chars"), F.lit(SALTS)).alias("salt"), _rank(F.col("chars"), F.col("key")).alias("rank"))
    best = (F.max("rank").alias("rank"), F.count("*").alias("n"))
    groups = ranked.where(~hot).groupBy("digest", "norm").agg(*best)
    if heavy:
        salted = ranked.where(hot).groupBy("digest", "norm", "salt").agg(*best)
        groups = groups.unionByName(salted.groupBy("digest", "norm").agg(F.max("rank").alias("rank"), F.sum("n").alias("n")))
    found = groups.select("digest", "norm", _key(F.col("rank")).alias("keep_id"), "n")
    index = settle(found.drop("norm"), "groups")

    clash = index.groupBy("digest").count().where("count > 1")
    if clash.isEmpty():
        rows = skewed_join(slim, index, ["digest"], index, rows_of(index))
    else:
        rows = base.join(found, ["digest", "norm"])
    kept = F.col("key").eqNullSafe(F.col("keep_id"))
    return rows.select(F.col("key").alias(key), "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), "digest")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with their columns; of rows that repeat the id (or have none) and the text that stays, the one with the most code points."""
    groups = settle(exact_groups(docs, key, text).select(key, "kept", "digest"), "groups")
    ids = groups.where(F.col(key).isNotNull())
    some = ids.count()
    unique, nameless = some == ids.select(key).distinct().count(), some < rows_of(groups)

    def once(rows: DataFrame) -> DataFrame:
        """One row of each id and text that stay."""
        whole = rows.select(F.col(key).alias("key"), F.struct(*rows.columns).alias("row"), F.col(text).alias("text"))
        marked = whole.withColumns({"digest": sha256(normalised(F.col("text"))), "chars": F.coalesce(F.char_length("text"), F.lit(0))})
        stay = groups.where("kept").select(F.col(key).alias("id"), F.col("digest").alias("stays")).distinct()
        marked = marked.join(stay, F.col("key").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("stays")), "left_semi")
        best = F.row_number().over(Window.partitionBy("key", "digest").orderBy(F.desc("chars"), "text"))
        return marked.withColumn("nth", best).where("nth = 1").select("row.*")

    if not unique:
        return once(docs)
    left = docs.join(small(settle(groups.where("not kept").select(key), "gone")), key, "left_anti").select(*docs.columns)
    return left.where(F.col(key).isNotNull()).unionByName(once(docs.where(F.col(key).isNull()))) if nameless else left
