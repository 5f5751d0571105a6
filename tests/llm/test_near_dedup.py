import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import common, near_dedup
from loomgrid.llm.components import components


def sets_of(rows, words):
    out = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out[key] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    return out


def brute(rows, words, percent):
    sets = sets_of(rows, words)
    low = {k: k for k in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                r, s = find(a), find(b)
                low[max(r, s)] = min(r, s)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in keys}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for group in range(6):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([2, 30, 60, 90]))]
        for _ in range(n // 6):
            edited = [rng.choice(vocabulary[:4]) if rng.random() < 0.015 else w for w in text]
            rows.append(" ".join(edited))
    rows += [None, "", "  ", "one", "ONE ", "one two", "One  two", "x " * 4000, "x " * 4000 + "y"]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize(("words", "percent", "seed"), [(3, 85, 1), (5, 80, 2), (3, 85, 3)])
def test_components_equal_brute_force(spark, words, percent, seed):
    rows = corpus(seed, 240)
    df = spark.createDataFrame([(k, t, 1, "n") for k, t in rows], "doc_id long, text string, n int, node string").repartition(4)
    got = near_dedup.near_components(df, words=words, percent=percent).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(rows, words, percent)


def test_blocks_smaller_than_a_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 5)
    rows = corpus(4, 180)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: tuple(r)[1:] for r in near_dedup.near_components(df, words=3, percent=85).collect()} == brute(rows, 3, 85)


def found(spark, rows, **k):
    df = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], "doc_id long, text string, n int, sig string, component long")
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(df, **k).collect()), key=str)


def test_edges(spark):
    assert near_dedup.near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B c d e f"), (None, "a b c d e f"), (3, None)]
    assert found(spark, rows) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (None, 2, None, True)]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 1, 3]


def test_repeated_ids_join_all_their_texts(spark):
    a, b = "one two three four", "five six seven eight nine"
    got = found(spark, [(1, b), (2, a), (2, b), (3, a), (4, a + " x"), (2, "")], words=3, percent=85)
    assert got == [(1, 3, 1, True), (2, 0, 1, False), (2, 2, 1, False), (2, 3, 1, False), (3, 2, 1, False), (4, 3, 4, True)]


def test_words_that_are_complements_are_different(spark):
    word = "a"
    for _ in range(11):  # Thue-Morse words collide under polynomials modulo 2**64
        word += word.translate({97: 98, 98: 97})
    assert found(spark, [(1, word), (2, word.translate({97: 98, 98: 97}))], words=3, percent=85) == [(1, 1, 1, True), (2, 1, 2, True)]


def test_similarities_at_the_threshold_are_links(spark):
    words = [f"w{i}" for i in range(19)]  # 17 shingles of three words; 17 of 20 is 85 percent
    more, less = [*words, "x", "y", "z"], [*words, "x", "y", "z", "q"]
    assert [r[2] for r in found(spark, [(1, " ".join(words)), (2, " ".join(more)), (3, " ".join(less))], words=3, percent=85)] == [1, 1, 1]
    assert [r[2] for r in found(spark, [(1, " ".join(words)), (3, " ".join(less))], words=3, percent=85)] == [1, 3]


def test_collisions_are_counted():
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 3, (20, 12)).astype(np.int32), rng.integers(0, 3, (30, 12)).astype(np.int32)
    want = (left[:, None, :] == right[None, :, :]).sum(2)
    for match in range(1, 13):
        assert (near_dedup.collisions(left, right, match) == (want >= match)).all()


def test_hot_keys_are_split(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    left = spark.createDataFrame([(i % 5 if i % 3 else 7, i) for i in range(200)], "k long, v long")
    right = spark.createDataFrame([(k, f"r{k}") for k in (0, 1, 2, 7, 9)], "k long, name string")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got, want = common.skewed_join(left, right, ["k"], counts, 5, how), left.join(right, "k", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    rows = corpus(5, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: tuple(r)[1:] for r in near_dedup.near_components(df, words=3, percent=85).collect()} == brute(rows, 3, 85)


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 150)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


def test_match_threshold():
    assert near_dedup.match_threshold(85, 40) > near_dedup.match_threshold(80, 40) > 10
