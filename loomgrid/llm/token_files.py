"""Flat token files: writing them, and counting the tokens of their documents by a separator scan.

A file is nothing but token ids of a fixed width, with an end-of-document id after each document; no
index says where documents begin. The width follows from the vocabulary: two bytes up to 65,536 ids,
else four. Files are cut into blocks of fixed size that are read by offset,
each by whichever task. A block's separators are found by one vectorised comparison; its documents
come out as gaps between them, the last one open. A prefix scan over the blocks' open ends then adds
what earlier blocks have left to the first separator of a later one: within runs of blocks, then
over the runs, so no task sees all blocks of a long file.

Defined cases: two separators in a row enclose a document of no tokens; tokens after the last
separator of a file are a document without an end; an empty file has no documents; a null or empty
text is written as its separator alone; texts are encoded with special tokens as plain text, and a
separator id inside a text's ids, or an id that the width cannot hold, is an error; a text of any
length is one document, over as many blocks as it takes; repeated rows are documents of their own, and
null ids are kept; an empty table gives no rows; other columns are not used, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import settle, shared_dir

BLOCK_TOKENS = 1 << 20
RUN = 256  # blocks whose open ends one window adds up


def _open(path: str):
    where, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return where, name


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def id_type(size: int) -> str:
    """The narrowest type of the ids of a vocabulary."""
    return "<u2" if size <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, eod: int, key: str = "doc_id", text: str = "text", dtype: str | None = None) -> DataFrame:
    """Encode texts and write one flat file for each partition; one row per document: key, file, doc_index. The type of the ids is that of the vocabulary unless another is given.

    A file is named after its partition and moved into place when it is whole, so a task that runs
    again writes the same file. The returned rows are settled: the files are there."""
    shared = bpe.broadcast_vocabulary(docs.sparkSession, tokenizer)
    dtype = dtype or id_type(shared.value[1].size)
    largest = np.iinfo(dtype).max
    if not 0 <= eod <= largest:
        raise ValueError(f"{dtype} cannot hold the separator {eod}")
    kind = docs.schema[key].dataType.simpleString()
    folder = _uri(folder)

    def run(batches):
        from pyspark import TaskContext

        own, task = bpe.encoder_of(shared), TaskContext.get()
        where, base = _open(folder)
        where.create_dir(base, recursive=True)
        name = f"{base}/part-{task.partitionId():06d}.bin"
        part_name, index = f"{name}.{task.taskAttemptId()}.tmp", 0
        with where.open_output_stream(part_name) as out:
            for batch in batches:
                for part, texts in bpe.text_parts(batch):
                    ids, offs = own.encode_plain(texts)
                    if len(ids) and (int(ids.max()) > largest or (ids == eod).any()):
                        raise ValueError(f"a text has the separator {eod} among its ids, or an id that {dtype} cannot hold")
                    flat = np.full(len(ids) + len(texts), eod, dtype)
                    flat[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(offs))] = ids
                    out.write(flat.tobytes())
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([name.rpartition("/")[2]] * n), pa.array(np.arange(index, index + n))], ["key", "file", "doc_index"])
                    index += n
        try:
            where.move(part_name, name)
        except OSError:  # another attempt of this task was first, and some stores do not replace files
            if where.get_file_info(name).type == fs.FileType.NotFound:
                raise
            where.delete_file(part_name)

    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = source.mapInArrow(run, f"key {kind}, file string, doc_index bigint")
    return settle(rows.withColumnRenamed("key", key), "written")


def blocks_of(spark: SparkSession, folder: str, width: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, path, start, size) in bytes of the flat files of a folder; only their lengths are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    step = width * block_tokens
    start = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / step)))
    cut = files.where("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "length", start.alias("block"))
    return cut.select("file", "block", "path", (F.col("block") * step).alias("start"), F.least(F.lit(step), F.col("length") - F.col("block") * step).alias("size"))


def scan_blocks(blocks: DataFrame, eod: int, dtype: str = "<u2") -> DataFrame:
    """One row per block: file, block, ends (offsets of its separators, in tokens) and n_tokens."""
    width = np.dtype(dtype).itemsize

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                where, name = _open(_uri(r["path"]))
                with where.open_input_file(name) as f:
                    f.seek(r["start"])
                    data = np.frombuffer(f.read(r["size"]), dtype)
                ends = np.flatnonzero(data == np.array(eod, dtype))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]]), pa.array([r["block"]], pa.int64()), pa.array([ends], pa.list_(pa.int64())), pa.array([r["size"] // width], pa.int64())],
                    ["file", "block", "ends", "n_tokens"],
                )

    return blocks.repartition(F.xxhash64("file", "block")).mapInArrow(run, "file string, block bigint, ends array<bigint>, n_tokens bigint")


def document_lengths(scanned: DataFrame) -> DataFrame:
    """Stitch blocks: one row per document: file, doc_index, first_token (in its file), n_tokens, complete."""
    n = F.size("ends")
    tail = F.when(n > 0, F.col("n_tokens") - F.element_at("ends", -1) - 1).otherwise(F.col("n_tokens"))
    scanned = settle(scanned.withColumns({"run": F.floor(F.col("block") / RUN), "tail": tail.cast("bigint"), "docs": n.cast("bigint")}), "blocks")
    slim = scanned.select("file", "run", "block", "n_tokens", "tail", "docs")

    # before each block of a run: its documents and tokens, and what is open since the run's last separator
    past = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = slim.withColumn("through", F.sum("n_tokens").over(upto))
    open_ = F.max(F.when(F.col("docs") > 0, F.struct("block", "tail", "through"))).over(past)
    inner = ends.withColumn("o", open_).withColumns({"d0": F.coalesce(F.sum("docs").over(past), F.lit(0)), "t0": F.col("through") - F.col("n_tokens")})
    inner = inner.select("file", "run", "block", "d0", "t0", F.when(F.col("o").isNull(), F.col("t0")).otherwise(F.col("o.tail") + F.col("t0") - F.col("o.through")).alias("carry"), F.col("o").isNull().alias("fresh"))

    # the same over the runs of a file
    whole = ends.groupBy("file", "run").agg(F.sum("docs").alias("docs"), F.max("through").alias("n_tokens"), F.max(F.when(F.col("docs") > 0, F.struct("block", "tail", "through"))).alias("o"))
    whole = whole.withColumn("tail", F.when(F.col("o").isNull(), F.col("n_tokens")).otherwise(F.col("o.tail") + F.col("n_tokens") - F.col("o.through")))
    before, through = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = whole.withColumn("through", F.sum("n_tokens").over(through))
    runs = whole.withColumn("r", F.max(F.when(F.col("docs") > 0, F.struct("run", "tail", "through"))).over(before)).withColumns({"rd": F.coalesce(F.sum("docs").over(before), F.lit(0)), "rt": F.col("through") - F.col("n_tokens")})
    runs = runs.select("file", "run", "rd", "rt", F.when(F.col("r").isNull(), F.col("rt")).otherwise(F.col("r.tail") + F.col("rt") - F.col("r.through")).alias("rcarry"), (F.row_number().over(Window.partitionBy("file").orderBy(F.desc("run"))) == 1).alias("final"), F.col("tail").alias("run_tail"), F.col("docs").alias("run_docs"), F.col("through"))

    at = inner.join(runs.select("file", "run", "rd", "rt", "rcarry"), ["file", "run"]).select("file", "block", (F.col("d0") + F.col("rd")).alias("d0"), (F.col("t0") + F.col("rt")).alias("t0"), F.when(F.col("fresh"), F.col("carry") + F.col("rcarry")).otherwise(F.col("carry")).alias("carry"))
    each = scanned.select("file", "block", F.posexplode("ends").alias("i", "end"), F.when(F.size("ends") > 0, F.col("ends")).alias("ends"))
    each = each.withColumn("gap", F.when(F.col("i") == 0, F.col("end")).otherwise(F.col("end") - F.get("ends", F.col("i") - 1) - 1)).drop("ends")
    done = each.join(at, ["file", "block"])
    size = F.col("gap") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)
    closed = done.select("file", (F.col("d0") + F.col("i")).alias("doc_index"), (F.col("t0") + F.col("end") - size).alias("first_token"), size.alias("n_tokens"), F.lit(True).alias("complete"))
    rest = runs.where("final").withColumn("left", F.when(F.col("run_docs") > 0, F.col("run_tail")).otherwise(F.col("run_tail") + F.col("rcarry")))
    open_end = rest.where("left > 0").select("file", (F.col("rd") + F.col("run_docs")).alias("doc_index"), (F.col("through") - F.col("left")).alias("first_token"), F.col("left").alias("n_tokens"), F.lit(False).alias("complete"))
    return closed.unionByName(open_end)


def count_tokens(spark: SparkSession, folder: str, eod: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document of the flat files of a folder: file, doc_index, first_token, n_tokens, complete."""
    return document_lengths(scan_blocks(blocks_of(spark, folder, np.dtype(dtype).itemsize, block_tokens), eod, dtype))


def document_token_counts(docs: DataFrame, tokenizer: str, eod: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the texts as flat token files in the shared folder and count them there: key, file, doc_index, first_token, n_tokens."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(where)
    store.deleteOnExit(where)
    dtype = id_type(bpe.vocabulary(tokenizer).size)
    written = write_token_files(docs, folder, tokenizer, eod, key, text, dtype)
    counted = count_tokens(spark, folder, eod, dtype)
    return written.join(counted, ["file", "doc_index"]).select(key, "file", "doc_index", "first_token", "n_tokens")
