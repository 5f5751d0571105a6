import random

import numpy as np
import pytest

from loomgrid.llm import token_files
from loomgrid.llm.queries import tokenizer_path

EOD = 9


def expected(data):
    out, start = [], 0
    for i, x in enumerate(data):
        if x == EOD:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(data):
        out.append((len(out), start, len(data) - start, False))
    return out


@pytest.mark.parametrize("run", [2, 256])
def test_documents_across_blocks(spark, tmp_path, monkeypatch, run):
    monkeypatch.setattr(token_files, "RUN", run)
    rng = random.Random(1)
    files = {}
    for k in range(14):
        length = [0, 1, 7, 40, 200][k % 5]
        share = [0.5, 0.02, 0.0, 1.0][k % 4]
        files[f"f{k}.bin"] = [EOD if rng.random() < share else rng.randint(0, 8) for _ in range(length)]
    for name, data in files.items():
        np.array(data, "<u2").tofile(tmp_path / name)
    got = {}
    for r in token_files.count_tokens(spark, str(tmp_path), EOD, block_tokens=5).collect():
        got.setdefault(r.file, []).append((r.doc_index, r.first_token, r.n_tokens, r.complete))
    for name, data in files.items():
        assert sorted(got.get(name, [])) == expected(data), name


def test_counts_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = ["some words here", None, "", "é" * 50, "<|endoftext|> stays text", "x " * 3000]
    df = spark.createDataFrame([(i, t, "f", 0) for i, t in enumerate(texts)], "doc_id long, text string, file string, n_tokens int").repartition(3)
    own = Tokenizer.from_file(tokenizer_path())
    own.encode_special_tokens = True
    rows = token_files.document_token_counts(df, tokenizer_path(), 50256).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert token_files.document_token_counts(df.limit(0), tokenizer_path(), 50256).collect() == []
