"""Vectors of windows, and their truncated singular value decomposition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, pattern


def window_measures(chunks: DataFrame, measures: DataFrame) -> DataFrame:
    """Windows with their four measures as an ordered array: one join by chart and measure, then a group of four."""
    m = measures.select("chart_id", "idx", "text", "bpm", "beats", "duration_seconds")
    keys = [c for c in chunks.columns]
    rows = chunks.withColumn("idx", F.explode(F.sequence("start_measure", "end_measure"))).join(m, ["chart_id", "idx"])
    item = F.struct("idx", "text", "bpm", "beats", "duration_seconds")
    values = [F.first(c).alias(c) for c in keys if c not in ("chart_id", "chunk_index")]
    return rows.groupBy("chart_id", "chunk_index").agg(*values, F.array_sort(F.collect_list(item)).alias("measures"))


def embed(windows: DataFrame, key: str = "key", features: int = 0) -> DataFrame:
    """key, vector, event counts, beats, tempo and, for `features`, that many of the largest features of each block. No shuffle; a window that cannot be read has an error."""
    kind = dict(windows.dtypes)[key]
    schema = f"key {kind}, vector array<float>, event_count int, weighted_event_count double, total_beats double, rhythm_bpm double, top map<string,array<struct<name:string,value:double>>>, error string"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for r in batch.slice(lo, 256).to_pylist():
                    try:
                        e = pattern.embed(r["measures"], r["overlap_slots"])
                        top = {b: [{"name": n, "value": v} for n, v in f] for b, f in pattern.top_features(e["blocks"], features).items()} if features else None
                        rows.append({"key": r["key"], "vector": e["vector"].astype(np.float32), "top": top, **{k: e[k] for k in ("event_count", "weighted_event_count", "total_beats", "rhythm_bpm")}})
                    except ValueError as error:
                        rows.append({"key": r["key"], "error": str(error)})
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return windows.select(F.col(key).alias("key"), "measures", "overlap_slots").mapInArrow(run, schema).withColumnRenamed("key", key)


def slide_table(spark) -> DataFrame:
    """The lookup table of slide segments: a fixed 1,280 rows, for a broadcast join."""
    return spark.createDataFrame([(s, a, m, b, n, w) for s, a, m, b, n, w in geometry.table()], "shape string, start int, middle int, end int, length double, soft array<double>")


def symmetries(spark) -> DataFrame:
    """The sixteen symmetries of the ring: number, rotation, mirror."""
    return spark.range(16).select(F.col("id").cast("int").alias("turn"), (F.col("id") % 8).cast("int").alias("rotation"), (F.col("id") >= 8).alias("mirror"))


def turned(lane, rotation="rotation", mirror="mirror"):
    """A lane column under a symmetry."""
    lane, rotation, mirror = (F.col(c) if isinstance(c, str) else c for c in (lane, rotation, mirror))
    return (F.pmod(F.when(mirror, 1 - lane).otherwise(lane - 1) + rotation, F.lit(8)) + 1).cast("int")


def pool(contributions: DataFrame, keys: list[str], spark=None) -> DataFrame:
    """Mean and maximum over the symmetries of sums by feature (turn, feature, value). Features a symmetry does not have count as 0."""
    sums = contributions.groupBy(*keys, "feature", "turn").agg(F.sum("value").alias("value"))
    out = sums.groupBy(*keys, "feature").agg((F.sum("value") / 16).alias("mean"), F.max("value").alias("most"), F.count("*").alias("n"))
    return out.withColumn("most", F.when(F.col("n") < 16, F.greatest("most", F.lit(0.0))).otherwise(F.col("most"))).drop("n")


def dimension(vectors: DataFrame, column: str) -> int:
    """The length that all vectors have; null and ragged ones are an error that says how many there are."""
    n = F.size(column)
    seen = vectors.agg(F.max(n).alias("d"), F.count("*").alias("rows"), F.count(F.col(column)).alias("there"), F.count_if(F.exists(column, lambda x: x.isNull())).alias("holes"), F.min(n).alias("least")).first()
    d = seen["d"] or 0
    if seen["there"] < seen["rows"] or seen["holes"] or seen["least"] not in (None, d):
        bad = vectors.where(F.col(column).isNull() | (n != d) | F.exists(column, lambda x: x.isNull())).count()
        raise ValueError(f"{bad} of {seen['rows']} vectors are null, have nulls or another length than {d}")
    return d


def svd(vectors: DataFrame, key: str, column: str, k: int, rounds: int = 7, extra: int = 10, seed: int = 20260707) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(key and unit vector of length k, singular values, right vectors) of the uncentred matrix of all rows.

    Randomised subspace iteration: a d by (k + extra) basis is all that is held on the driver and sent out, whatever
    the number of rows; each round is one pass that adds up A'(AQ) in every task. Signs are those that make each
    right vector's largest element positive."""
    d = dimension(vectors, column)
    k = min(k, d)
    width = min(d, k + extra)
    spark = vectors.sparkSession
    if d == 0:
        return vectors.select(key, F.array().cast("array<float>").alias(column)), np.zeros(0), np.zeros((0, 0))
    rows = vectors.select(F.col(column).cast("array<float>").alias("v"))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]

    def gram(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q.astype(np.float64))

        def run(batches):
            total = np.zeros((d, width))
            for batch in batches:
                a = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
                total += a.T @ (a @ shared.value)
            for i in range(0, d, 64):  # a few rows of the sum at a time
                part = total[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array(list(part))], ["i", "row"])

        parts = rows.mapInArrow(run, "i bigint, row array<double>")
        each = [F.sum(F.get("row", F.lit(j))).alias(f"c{j}") for j in range(width)]
        found = parts.groupBy("i").agg(*each).toPandas().sort_values("i")
        return found.drop(columns="i").to_numpy()

    for _ in range(rounds):
        q = np.linalg.qr(gram(q))[0]
    s = gram(q)
    small = q.T @ s
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:k]
    right = q @ turn[:, order]
    right *= np.where(right[np.abs(right).argmax(0), np.arange(right.shape[1])] < 0, -1, 1)
    return project(vectors, key, column, right), np.sqrt(np.maximum(values[order], 0)), right


def project(vectors: DataFrame, key: str, column: str, right: np.ndarray) -> DataFrame:
    """Vectors times the right vectors, scaled to length 1 (0 stays 0)."""
    if dimension(vectors, column) not in (0, len(right)):
        raise ValueError(f"vectors do not have the length {len(right)}")
    shared = vectors.sparkSession.sparkContext.broadcast(right)
    kind = dict(vectors.dtypes)[key]

    def run(batches):
        for batch in batches:
            a = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64) @ shared.value
            size = np.sqrt((a**2).sum(1, keepdims=True))
            a = np.where(size > 0, a / np.where(size > 0, size, 1), a).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(a), pa.list_(pa.float32()))], ["key", "vector"])

    out = vectors.select(F.col(key).alias("key"), F.col(column).cast("array<float>").alias("vector")).mapInArrow(run, f"key {kind}, vector array<float>")
    return out.withColumnsRenamed({"key": key, "vector": column})


def sparsity(vectors: DataFrame, column: str) -> DataFrame:
    """One row: number of rows, elements that are not 0, their share."""
    nonzero = F.size(F.filter(column, lambda x: x != 0))
    return vectors.agg(F.count("*").alias("rows"), F.sum(nonzero).alias("nonzero"), (F.sum(nonzero) / F.sum(F.size(column))).alias("share"))


def save_model(spark, right: np.ndarray, values: np.ndarray, path: str) -> None:
    """The decomposition as a Parquet table: component, singular value, right vector."""
    rows = [(i, float(v), [float(x) for x in right[:, i]]) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "component int, singular_value double, vector array<double>").write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> tuple[np.ndarray, np.ndarray]:
    rows = spark.read.parquet(path).orderBy("component").collect()
    return np.array([r["vector"] for r in rows]).T, np.array([r["singular_value"] for r in rows])
