"""Document fingerprints by one-permutation MinHash.

Each 5-word shingle is hashed once; the upper bits of the hash name one of BINS bins, which keeps
its least hash. Empty bins are filled by optimal densification: each draws bins from a sequence that
depends on its own number alone, the same for all documents, until it finds one that was filled. Of
every bin the low BITS bits of its mixed hash are stored, packed as hexadecimal digits. The share of
equal bins is corrected for values that agree by chance.

Defined cases: texts without words (null, empty) have the empty fingerprint, alike only to another
empty one; texts with fewer than five words have one shingle; texts of any length are read whole, in
parts; equal texts have equal fingerprints, so do repeated rows; rows that repeat an id follow each
other by their text, and null ids come last; a table of one row is its own next document; an empty
table gives no rows; other columns are not used, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import pieces, text_bytes

BINS, BITS, WORDS = 256, 4, 5
MOST_BUCKETS = 1 << 16  # bounds that reach the driver
ROWS = 2048  # documents whose bins are in memory at once
BUCKET_ROWS = 1 << 14  # documents of a bucket, about


@lru_cache(1 << 14)
def draw(t: int) -> np.ndarray:
    """The bin that each bin draws in its attempt `t`."""
    return np.random.default_rng((11, t)).integers(0, BINS, BINS)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """The stored bits [document, bin] of sets of sorted distinct shingle hashes; rows of empty sets are 255."""
    out = np.full((len(sets), BINS), 255, np.uint8)
    rows = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(rows):
        return out
    flat = np.concatenate([sets[i] for i in rows])
    doc = np.repeat(np.arange(len(rows)), [len(sets[i]) for i in rows])
    cell = doc * BINS + (flat >> kernels.U64(64 - BINS.bit_length() + 1)).astype(np.int64)
    head = np.flatnonzero(np.diff(cell, prepend=-1))  # sorted hashes: the first of a bin is its least
    least = np.zeros(len(rows) * BINS, np.uint64)
    full = np.zeros(len(rows) * BINS, bool)
    least[cell[head]], full[cell[head]] = flat[head], True
    least, full = least.reshape(-1, BINS), full.reshape(-1, BINS)
    number = full.sum(1)
    one = number == 1  # all draws end in the only filled bin
    least[one] = least[one].max(1, keepdims=True)
    d, b = np.nonzero(~full & ~one[:, None])
    t = 0
    while len(d):
        source = draw(t)[b]
        hit = full[d, source]
        least[d[hit], b[hit]] = least[d[hit], source[hit]]
        d, b = d[~hit], b[~hit]
        t += 1
    out[rows] = (kernels.mix(least) & kernels.U64((1 << BITS) - 1)).astype(np.uint8)
    return out


def packed(bits: np.ndarray) -> list[str]:
    pairs = (bits[:, 0::2] << 4 | bits[:, 1::2] & 15).astype(np.uint8)
    return ["" if row[0] == 255 else pair.tobytes().hex() for row, pair in zip(bits, pairs, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the documents of two arrays of bits, row by row."""
    chance = 1 / (1 << BITS)
    value = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    none, other = a[:, 0] == 255, b[:, 0] == 255
    return np.where(none | other, (none & other).astype(float), value)


def of_texts(texts: list[str]) -> np.ndarray:
    return fingerprints(kernel_sets(pa.array(texts, pa.string())))


def kernel_sets(column: pa.Array) -> list[np.ndarray]:
    return kernels.shingle_sets(*text_bytes(column), WORDS)


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fingerprint of each text. No shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in batch_parts(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed(fingerprints(kernel_sets(part.column(1)))), pa.string())], ["key", "fingerprint"])

    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(run, f"key {kind}, fingerprint string").withColumnRenamed("key", key)


def batch_parts(batch: pa.RecordBatch, column: int):
    _, offs = text_bytes(batch.column(column))
    for i, j in pieces(offs):
        for k in range(i, j, ROWS):  # many short texts: their bins need more room than their bytes
            yield batch.slice(k, min(ROWS, j - k))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the descending bounds are above the key, by binary search; null keys come last."""
    steps = F.array(*(F.lit(1 << s) for s in reversed(range(max(1, len(bounds)).bit_length()))))
    table = F.array(*(F.lit(b).cast("bigint") for b in bounds)) if bounds else F.array().cast("array<bigint>")
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) > key, F.lit(False)), at + step).otherwise(at))
    return F.when(key.isNull(), F.lit(len(bounds) + 1)).otherwise(found)


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (bucket, tail, key, text), partitioned by bucket and sorted so that the next row of a bucket is the next document by descending key.

    Ids are cut at approximate quantiles into buckets of about BUCKET_ROWS documents, MOST_BUCKETS at
    most; the first document of each bucket is copied to the end of the bucket before (the very first to
    the last). Texts are shuffled once; only bounds and first ids, one for each bucket, reach the driver
    and go back as a table of that bound, which is broadcast."""
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    buckets = min(MOST_BUCKETS, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), base.count() // BUCKET_ROWS))
    cuts = base.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("q")).first()["q"] or []
    bucket = _bucket(F.col("key"), sorted(set(cuts), reverse=True))
    firsts = base.groupBy(bucket.alias("bucket")).agg(F.max("key").alias("first")).orderBy("bucket").collect()
    before = [(r["first"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    to = spark.createDataFrame(before, "first bigint, copy_to int")
    base = base.join(F.broadcast(to), F.col("key").eqNullSafe(F.col("first")), "left")
    copies = F.array_compact(F.array("copy_to"))
    first = F.struct(bucket.cast("int").alias("bucket"), F.lit(False).alias("tail"))
    tails = F.transform(copies, lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("tail")))
    rows = base.select("key", "text", F.explode(F.concat(F.array(first), tails)).alias("p")).select("p.bucket", "p.tail", "key", "text")
    # as many partitions as buckets, so that tasks keep their size however many documents there are
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("key"), "text")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last third is replaced by the start of the next document by descending id, and their likeness.

    Repeated ids follow each other by their text; null ids come last."""

    def run(batches):
        held: tuple | None = None  # the last row, until its next is known
        for batch in batches:
            for part in batch_parts(batch, 3):
                rows = list(zip(*(part.column(c).to_pylist() for c in range(4)), strict=True))
                if held is not None:
                    rows = [held, *rows]
                yield from finish(rows)
                held = rows[-1]

    def finish(rows):
        bits = of_texts([r[3] for r in rows])
        pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not pairs:
            return
        texts = []
        for i in pairs:
            own, after = rows[i][3], rows[i + 1][3]
            cut = len(own) // 3
            texts.append(own[: len(own) - cut] + after[:cut])
        new = of_texts(texts)
        at = np.array(pairs)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in pairs], pa.int64()),
                pa.array([len(rows[i][3]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                pa.array(packed(bits[at]), pa.string()),
                pa.array(packed(new), pa.string()),
                pa.array(likeness(bits[at], new), pa.float64()),
                pa.array(likeness(bits[at], bits[at + 1]), pa.float64()),
            ],
            ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    out = neighbours(docs, key, text).mapInArrow(run, "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("key", key)
