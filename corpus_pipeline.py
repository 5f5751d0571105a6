"""A training-data pipeline over the documents table.

Language identification, exact deduplication, near-duplicate removal, secret scans and best-fit
packing, in this order. Each stage takes the documents that the one before has kept, is written as
Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgrid.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from loomgrid.llm.common import settle


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: texts without a letter go, and those far from every language of the table.

    Null and empty texts go; without a labelled row all texts with a letter stay; rows are judged each by
    their own whole text, whatever their ids; an empty table stays empty; all columns are kept as they are."""
    return language_id.keep_languages(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the one with the most code points, then the smallest id.

    A null text counts as empty; rows without an id take part, after those that have one; of rows that repeat
    an id each text is held once; an empty table stays empty; all columns are kept, whatever their names."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the smallest id: shingles of five words, similarity 0.8 or more.

    Documents without words, and rows without an id, are linked with nothing and stay; rows that repeat an id
    go or stay together; whole texts are compared, however long; an empty table stays empty; all columns are kept."""
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by the kind and n_chars counted anew where that happens.

    Null texts stay null; overlapping spans are replaced as one; rows are scanned each, whatever their ids;
    an empty table stays empty; all other columns are kept as they are."""
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences: doc_id, piece, first_token, n_tokens, bin_id, bin_size, bin_offset.

    Null and empty texts have one empty piece in bin -1; texts longer than the longest sequence have several;
    rows that repeat an id, and those without one, are packed each; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("secret_scan", secret_stage),
    ("best_fit_packing", packing_stage),
]
#: SQL expresses neither the near-duplicate groups nor the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
