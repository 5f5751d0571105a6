from collections import Counter
import random

import pytest

from loomgrid.llm import packing


def one_by_one(histogram, sizes, price=packing.token_price):
    """Best-fit decreasing, a piece at a time."""
    items = sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True)
    unit = min(price(s) / s for s in sizes)
    bins = []
    for i, n in enumerate(items):
        fit = [b for b in bins if b[0] >= n]
        if fit:
            best = min(fit, key=lambda b: (b[0], b[1]))
        else:
            left = sum(x == n for x in items[i:])

            def loss(size):
                same = min(left, size // n)
                room = size - same * n
                return price(size) - unit * (same * n + min(room, sum(x for x in items[i:] if x < n and x <= room))), size

            size = min((s for s in sizes if s >= n), key=loss)
            best = [size, size, 0]
            bins.append(best)
        best[0] -= n
        best[2] += n
    return Counter((min(s for s in sizes if s >= used), used) for _, _, used in bins)


@pytest.mark.parametrize("seed", range(150))
def test_plan_equals_packing_one_by_one(seed):
    rng = random.Random(seed)
    sizes = tuple(sorted(rng.sample(range(4, 60), rng.randint(1, 4))))
    histogram = {n: rng.randint(1, 12) for n in rng.sample(range(1, sizes[-1] + 1), rng.randint(1, min(sizes[-1], 20)))}
    bins = packing.plan(histogram, sizes)
    found = Counter()
    for size, number, inside in bins:
        found[size, sum(n * k for n, k in inside)] += number
    assert found == one_by_one(histogram, sizes)
    held = Counter()
    for _, number, inside in bins:
        for n, k in inside:
            held[n] += number * k
    assert held == histogram


def test_a_length_beyond_all_sizes_is_refused():
    with pytest.raises(ValueError):
        packing.plan({9: 1}, (4, 8))


def test_plan_of_nothing():
    assert packing.plan({}) == []


def check(rows, texts, sizes):
    """Every token once, no overlap in a bin, the smallest size for each bin's contents."""
    bins, docs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        if r.bin_id >= 0:
            bins.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens, r.bin_size))
    for pieces in bins.values():
        at = 0
        for offset, n, size in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert {p[2] for p in pieces} == {min(s for s in sizes if s >= at)}
    for key, text in texts:
        n = len((text or "").split())
        spans = sorted(docs[key])
        assert spans[0][0] == 0 and sum(x for _, x in spans) == n
        assert all(a + x == b for (a, x), (b, _) in zip(spans, spans[1:]))


def test_pack(spark):
    rng = random.Random(3)
    texts = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([1, 3, 3, 3, 7, 20, 45])))) for i in range(300)]
    texts += [(300, None), (301, ""), (302, "  \n"), (303, "x " * 5000)]
    df = spark.createDataFrame([(i, t, "a", i) for i, t in texts], "doc_id long, text string, n_tokens string, piece long")
    sizes = (8, 16, 32)
    rows = packing.pack(df, sizes=sizes).collect()
    check(rows, texts, sizes)
    assert packing.pack(df.limit(0), sizes=sizes).collect() == []
    twice = packing.pack(df.union(df), sizes=sizes).collect()
    assert len(twice) == 2 * len(rows)
