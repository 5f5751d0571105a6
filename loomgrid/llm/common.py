"""What the operators of this subpackage share: lineage cuts, joins on hot keys and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A counted side of at most this many bytes of numbers may be broadcast; beyond it the joins shuffle.
BROADCAST_BYTES = 4 << 20
#: Keys with more than HOT_ROWS rows and more than one HOT_KEYS-th of all rows are split in joins: at most HOT_KEYS keys.
HOT_ROWS, HOT_KEYS = 512, 1024
#: Rows and bytes of the batches that go to Python workers while a table is settled.
BATCH_ROWS, BATCH_BYTES = 1024, 2 << 20
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
#: White space of the contracts: space and U+0009 to U+000D.
BLANK = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session without one (tests) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loomgrid-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def settle(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    The files survive lost executors; they go when they are released, at the latest when the driver's
    JVM ends. The rows are counted while they are written, and the column n, if there is one, is summed
    up, so that joins can be chosen by the sizes of their sides without another job. Python workers get
    smaller Arrow batches than by default meanwhile: whole texts in batches of 10,000 rows hold several
    times their bytes. The session's own settings come back after."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    seen, counted = Observation(), [F.count(F.lit(1)).alias("rows")]
    if "n" in df.columns:
        counted += [F.max("n").alias("most"), F.sum("n").alias("total")]
    before = {k: spark.conf.get(k, None) for k in _BATCHES}
    try:
        for k, v in _BATCHES.items():
            spark.conf.set(k, str(v))
        df.observe(seen, *counted).write.parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    store, where = _place(spark, path)
    store.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled, out._facts = path, seen.get
    return out


def rows_of(settled: DataFrame) -> int:
    """The rows of a settled table, as counted when it was written."""
    return settled._facts["rows"]


def release(*settled: DataFrame) -> None:
    """Delete the files of settled tables that no plan reads any more."""
    for df in settled:
        store, where = _place(df.sparkSession, df._settled)
        store.delete(where, True)


def _light(df: DataFrame, rows: int) -> bool:
    width = sum(8 if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else 64 for f in df.schema.fields)
    return rows * width <= BROADCAST_BYTES


def small(settled: DataFrame) -> DataFrame:
    """Mark a settled table for broadcast if it is small enough, else leave the join to shuffle."""
    return F.broadcast(settled) if _light(settled, rows_of(settled)) else settled


def skewed_join(left: DataFrame, right: DataFrame, on: list[str], counts: DataFrame, rows: int, how: str = "inner") -> DataFrame:
    """left.join(right, on, how), where `right` has one row for a key, `rows` in all, and `counts` (on, n) the rows of `left` for each.

    A right side of few bytes is broadcast. Else rows of a hot key are dealt over salts by a hash of the
    row, and its one row on the right is copied to each salt, so that no task gets more of a key than a
    small share of all rows. The hot keys are at most HOT_KEYS by construction, so their list may be broadcast."""
    if _light(right, rows):
        return left.join(F.broadcast(right), on, how)
    top = getattr(counts, "_facts", None) or counts.agg(F.max("n").alias("most"), F.sum("n").alias("total")).first().asDict()
    least = max(HOT_ROWS, (top["total"] or 0) // HOT_KEYS)
    if (top["most"] or 0) <= least:
        return left.join(right, on, how)
    hot = F.broadcast(counts.where(F.col("n") > least).select(*on, F.ceil(F.col("n") / least).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), salts)).drop("_salts")
    copied = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("_salts")
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, most: int = 1 << 19):
    """Ranges (i, j) of rows of at most `most` bytes together, or of one longer row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def held_out(doc_id) -> F.Column:
    """Rows kept from training: crc32 of the id as text leaves no remainder by 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
