"""The registered queries on the smallest driver tables: their SQL where there is some, and their contracts."""

import os

import pytest

from loomgrid.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")

COLUMNS = {
    "op1_best_fit_packing": "doc_id piece first_token n_tokens bin_id bin_size bin_offset",
    "op2_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_language_id": "doc_id held_out lang_pred score",
    "op4_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op5_token_counts": "doc_id file doc_index first_token n_tokens",
    "op6_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op7_quality": "doc_id held_out score predicted",
    "op8_license": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op9_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10_near_dedup": "doc_id n_shingles component_id kept",
}


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, SF)
    rows = [tuple(map(plain, r)) for r in df.collect()]
    if name in COLUMNS:
        assert set(COLUMNS[name].split()) <= set(df.columns)
    documents = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    at = df.columns.index("doc_id")
    assert {r[at] for r in rows} == documents
    assert name == "op1_best_fit_packing" or len(rows) == len(documents)
    if sql := queries.oracle_sql().get(name):
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        found = c.sql(sql)
        order = [found.columns.index(x) for x in df.columns]
        assert sorted(map(str, rows)) == sorted(str(tuple(plain(r[i]) for i in order)) for r in found.fetchall())
