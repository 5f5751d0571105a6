"""Every operator on null ids and texts, repeated rows, long texts, an empty table and columns with the names it uses itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgrid.llm import bpe, exact_dedup, fingerprint, kernels, language_id, license_scan, near_dedup, packing, quality, secret_scan, token_files
from loomgrid.llm.queries import tokenizer_path

OWN = "key norm digest chars rank salt n sig shingles node size token _key _norm _n _w _low _digest _chars bucket tail first copy_to total piece g x any good of ids n_tokens want members component a b".split()
TEXTS = [(1, "Some plain text, secret=abcdef1 here"), (1, "Some plain text, secret=abcdef1 here"), (None, "two words"), (None, None), (2, None), (3, ""), (4, "mit license " * 9000), (5, "日本語。" * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if t else None, f"s{k % 2}", len(t or ""), *["c"] * len(OWN)) for k, (i, t) in enumerate(TEXTS)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in OWN)
    return spark.createDataFrame(rows, schema).repartition(3).cache()


def labels(docs):
    return docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).distinct()


OPERATORS = {
    "op2": lambda d: bpe.encode(d, tokenizer_path(), decoded=True),
    "op2 count": lambda d: bpe.count(d, tokenizer_path()),
    "op3": language_id.identify,
    "op4": exact_dedup.exact_groups,
    "op5": lambda d: token_files.document_token_counts(d, tokenizer_path(), 50256).select("doc_id", "n_tokens"),
    "op6": fingerprint.fingerprint,
    "op6 edited": lambda d: fingerprint.edited_fingerprints(d).select("doc_id", "n_chars", "fingerprint"),
    "op7": lambda d: quality.classify(d, labels(d)),
    "op8": license_scan.scan,
    "op9": secret_scan.find_secrets,
    "op10": near_dedup.near_components,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_one_result(docs, name):
    rows = OPERATORS[name](docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in TEXTS)
    assert len({str(r) for r in rows if r.doc_id == 1}) == 1
    assert OPERATORS[name](docs.limit(0)).collect() == []


def test_packing_places_every_word(docs):
    rows = packing.pack(docs).collect()
    assert sum(r.n_tokens for r in rows) == sum(len((t or "").split()) for _, t in TEXTS)
    assert sum(r.bin_id == -1 for r in rows) == 3


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_columns(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {i for i, _ in TEXTS}
    assert stage(spark, docs.limit(0), "").collect() == []


# what single operators promise besides


@pytest.mark.parametrize(("size", "shared"), [(4, 2), (8, 5)])
def test_sparse_fingerprints_are_unbiased(size, shared):
    rng = np.random.default_rng(size)
    left, right = [], []
    for _ in range(1500):
        both = rng.integers(0, 2**64, 2 * size - shared, dtype=np.uint64)
        left.append(np.sort(kernels.mix(both[:size])))
        right.append(np.sort(kernels.mix(both[size - shared :])))
    found = fingerprint.likeness(fingerprint.fingerprints(left), fingerprint.fingerprints(right))
    assert abs(found.mean() - shared / (2 * size - shared)) < 0.02


def test_token_files_refuse_what_they_cannot_hold(spark, tmp_path):
    assert [token_files.id_type(n) for n in (50_000, 65_536, 65_537)] == ["<u2", "<u2", "<u4"]
    df = spark.createDataFrame([(1, "a a a")], "doc_id long, text string")
    own = bpe.Encoder(bpe.vocabulary(tokenizer_path())).encode_plain(["a"])[0][0]
    for eod, dtype in ((int(own), "<u2"), (50256, "u1"), (70_000, "<u2")):
        with pytest.raises(Exception, match="hold"):
            token_files.write_token_files(df, str(tmp_path), tokenizer_path(), eod, dtype=dtype).collect()
    wide = token_files.write_token_files(df, str(tmp_path / "wide"), tokenizer_path(), 70_000, dtype="<u4")
    assert wide.count() == 1 and token_files.count_tokens(spark, str(tmp_path / "wide"), 70_000, "<u4").first().n_tokens == 3


def test_several_sizes_cost_less_than_one():
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6, 1.2, 20_000).astype(int), 1, 8192)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    cost = lambda sizes: sum(packing.token_price(s) * n for s, n, _ in packing.plan(histogram, sizes))
    assert cost(packing.SIZES) < cost((8192,))


def test_packed_sequences_hold_the_ids(spark):
    rows = [(i, list(range(i, i + n))) for i, n in enumerate([5, 3, 8, 1, 0, 20, 7])]
    ids = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    placed = packing.pack_counted(ids.select("doc_id", F.size("ids").alias("n_tokens")), sizes=(4, 8))
    out = packing.sequences(placed, ids).collect()
    assert sorted(x for r in out for x in r.ids) == sorted(x for _, own in rows for x in own)
    assert all(len(r.ids) <= r.bin_size and r.starts[0] == 0 for r in out)


def test_every_language_is_learnt(spark):
    rng = np.random.default_rng(2)
    words = {f"l{k:03d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(6)] for k in range(300)}
    rows = [(10 * k + i, " ".join(rng.choice(w, 30)), name) for k, (name, w) in enumerate(words.items()) for i in range(2)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == sorted(words)
    mixed = " ".join(" ".join(rng.choice(words[n], 200)) for n in ("l000", "l001", "l002", "l003"))
    r = language_id.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert set(r.langs) == {"l000", "l001", "l002", "l003"} and all(abs(p - 0.25) < 0.02 for p in r.proportions)
