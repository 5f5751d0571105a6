"""Retrieval ranks, pooled features and the contrastive loss."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..plans.lineage import cut
from .numbering import numbered

BLOCK = 2048


def ranks(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """id, rank of each query's own candidate (the same id): one more than the candidates that score higher; equal scores do not count.

    A query's own score is joined first. Candidates are then cut into blocks and every block of queries is scored
    against every block by one matrix product; only counts for each query leave a task."""
    own = queries.join(candidates.select("id", F.col("vector").alias("_own")), "id").withColumn("target", vectors.dot(F.col("vector"), F.col("_own")))
    nq, nc = (max(1, -(-df.count() // BLOCK)) for df in (queries, candidates))
    kind = dict(queries.dtypes)["id"]
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    q = own.select("id", "vector", "target", F.pmod(F.xxhash64("id"), F.lit(nq)).alias("qb"), each(nc).alias("cb"))
    c = candidates.select("vector", F.pmod(F.xxhash64("id"), F.lit(nc)).alias("cb"), each(nq).alias("qb"))

    def matrix(t: pa.Table) -> np.ndarray:
        return np.array(t.column("vector").to_pylist(), float) if len(t) else np.zeros((0, 0))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({"id": left.column("id"), "above": pa.array([], pa.int64())})
        above = np.zeros(len(left), np.int64)
        if len(right):
            score = matrix(left) @ matrix(right).T
            above = (score > left.column("target").to_numpy()[:, None] + 1e-9).sum(1)
        return pa.table({"id": left.column("id"), "above": pa.array(above)})

    counts = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(count, f"id {kind}, above bigint")
    return counts.groupBy("id").agg((F.sum("above") + 1).alias("rank"))


def rank_metrics(rank: DataFrame) -> DataFrame:
    """One row: recall at 1, 5 and 10, mean reciprocal rank, lower median."""
    at = lambda k: F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_at_{k}")
    return rank.agg(F.count("*").alias("n"), at(1), at(5), at(10), F.avg(1 / F.col("rank")).alias("mrr"), F.expr("percentile_disc(0.5) within group (order by rank)").cast("bigint").alias("median_rank"))


def shifted_cosine(pairs: DataFrame, order: str, a: str = "a", b: str = "b") -> DataFrame:
    """Cosine of each row's a with its own b and with the b of the row before (the first: of the last).

    Rows are numbered by their order, and the row before is found by that number, so the vectors are joined, not gathered."""
    place = cut(numbered(pairs.select(order), [order], "_n"), "places")
    rows = pairs.join(place, order)
    total = place.count()
    before = rows.select(F.pmod(F.col("_n") + 1, F.lit(total)).alias("_n"), F.col(b).alias("_before"))
    out = rows.join(before, "_n")
    return out.select(order, vectors.cosine(F.col(a), F.col(b)).alias("cosine"), vectors.cosine(F.col(a), F.col("_before")).alias("shifted"))


def statistical_pooling(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, maximum and deviation (root of the population variance and 1e-6) of each dimension over the frames whose mask is set."""
    own = frames.where("mask")
    return own.groupBy(*keys).agg(F.avg("value").alias("mean"), F.max("value").alias("most"), F.sqrt(F.var_pop("value") + 1e-6).alias("deviation"))


def frame_mask(mask, frames):
    """The mask of feature frames of a sample mask: every stride-th sample, padded with false and cut to the number of frames."""
    stride = F.greatest(F.lit(1), F.floor(F.size(mask) / frames)).cast("int")
    return F.transform(F.sequence(F.lit(0), frames - 1), lambda i: F.coalesce(F.get(mask, i * stride), F.lit(False)))


def contrastive_loss(pairs: DataFrame, temperature: float = 0.07, distillation: float = 0.2) -> DataFrame:
    """One row: symmetric cross entropy of unit vectors a against b within each batch (columns batch, id, a, b), the distillation part and the whole loss.

    A batch is a few dozen rows, so its pairs are bounded by the batch size times the rows."""
    t = min(1.0, max(0.01, temperature))
    left, right = pairs.select("batch", F.col("id").alias("i"), "a"), pairs.select("batch", F.col("id").alias("j"), "b")
    logits = left.join(right, "batch").select("batch", "i", "j", (vectors.dot(F.col("a"), F.col("b")) / t).alias("x"))

    def entropy(side: str) -> DataFrame:
        top = logits.groupBy("batch", side).agg(F.max("x").alias("m"))
        rows = logits.join(top, ["batch", side])
        return rows.groupBy("batch", side).agg((F.log(F.sum(F.exp(F.col("x") - F.col("m")))) + F.max("m") - F.sum(F.when(F.col("i") == F.col("j"), F.col("x")).otherwise(0.0))).alias("loss"))

    one = entropy("i").agg(F.avg("loss").alias("forward")).crossJoin(entropy("j").agg(F.avg("loss").alias("backward")))
    cosine = pairs.agg((1 - F.avg(vectors.dot(F.col("a"), F.col("b")))).alias("distance"))
    return one.crossJoin(cosine).select(((F.col("forward") + F.col("backward")) / 2).alias("contrastive"), "distance", ((F.col("forward") + F.col("backward")) / 2 + F.col("distance") * distillation).alias("loss"))


def weighted_means(batches: DataFrame, metrics: list[str], size: str = "n") -> DataFrame:
    """Means of batch metrics weighted by batch size."""
    return batches.agg(*((F.sum(F.col(m) * F.col(size)) / F.sum(size)).alias(m) for m in metrics))
