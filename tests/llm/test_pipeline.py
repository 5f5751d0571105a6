import random
import re

import corpus_pipeline

from .test_near_dedup import brute
from .test_packing import check


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    texts = [" ".join(f"{rng.choice('abcdef')}{rng.randrange(40)}x" for _ in range(rng.randint(1, 120))) for _ in range(60)]
    texts += [texts[i] for i in range(10)] + [texts[i].replace(" ", "  ") for i in range(5)]
    texts += [texts[i] + " tail" for i in range(20)] + [None, "", "12 34", "token: abcdef1234"]
    langs = ["xx", "yy"]
    rows = [(i, t, langs[i % 2], "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    left = {i: t for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    groups = {}
    for i, t in left.items():
        groups.setdefault(re.sub(r"\s", "", t), []).append((-len(t), i))
    left = {i: left[i] for i in (min(g)[1] for g in groups.values())}
    near = brute(list(left.items()), 5, 80)
    left = {i: t for i, t in left.items() if near[i][2]}
    left = {i: t.replace("token: abcdef1234", "<assign>") for i, t in left.items()}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(left)
    check(got, list(left.items()), (512, 1024, 2048, 4096, 8192))


def test_stages_keep_the_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "a token=abcdef12", "en", "s", 16)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns and out.count() == 1
