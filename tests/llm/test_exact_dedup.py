import hashlib
import re

import pytest
from pyspark.sql import functions as F

from loomgrid.llm import exact_dedup

ROWS = [
    (5, "a b", "x"), (3, "a  b", "y"), (4, "ab  ", None), (9, None, "x"), (8, "", "x"), (7, " \n\t", "x"),
    (10, "é x", "x"), (11, "éx", "x"), (12, "a" * 200_000, "x"), (13, "a " * 200_000, "x"), (None, "ab   ", "x"), (-2, "ab  ", "z"),
]


def expected(rows):
    groups = {}
    for key, text, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), key is None, key or 0, key))
    out = []
    for key, text, _ in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[norm])[3]
        out.append((key, best, len(groups[norm]), key == best, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, s, 1) for k, t, s in rows], "doc_id long, text string, digest string, rank int")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.lit("same"), lambda c: F.substring(c, 1, 1)])
def test_groups(spark, digest):
    got = exact_dedup.exact_groups(frame(spark, ROWS).repartition(3), digest=digest).collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == [x[:4] for x in expected(ROWS)]


def test_heavy_digest_is_salted(spark):
    rows = [(i, "copy" + " " * (i % 7), "s") for i in range(3000)] + [(10_000 + i, f"text {i}", "s") for i in range(300)]
    got = exact_dedup.exact_groups(frame(spark, rows).repartition(8)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_empty_and_repeated(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).collect() == []
    rows = [(1, "a", "s"), (1, "a", "s"), (1, "b", "s"), (2, "a", "s"), (None, "a", "s")]
    kept = exact_dedup.deduplicate(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(1, "a"), (1, "b")]


@pytest.mark.parametrize("repeated", [False, True])
def test_deduplicate_rows_without_an_id(spark, repeated):
    rows = [(None, "a b", "s"), (None, "ab", "s"), (None, "a  b", "s"), (5, "ab", "s"), (None, "c", "s"), (6, "c", "s"), (7, "c  ", "s"), (None, None, "s"), (None, " ", "s"), (8, "d", "s")]
    rows += [(8, "d ", "s"), (8, "d  ", "s"), (8, "e", "s")] * repeated
    kept = exact_dedup.deduplicate(frame(spark, rows)).collect()
    want = [(None, " "), (None, "a  b"), (7, "c  "), *([(8, "d  "), (8, "e")] if repeated else [(8, "d")])]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)


def test_deduplicate_keeps_the_winners(spark):
    got = {r.doc_id for r in exact_dedup.deduplicate(frame(spark, [r for r in ROWS if r[0] is not None])).collect()}
    assert got == {k for k, best, *_ in expected([r for r in ROWS if r[0] is not None]) if k == best}
