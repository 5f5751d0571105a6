"""BPE, language identification, fingerprints, quality, licences and secrets."""

import hashlib
import random
import re
import time
import unicodedata

import numpy as np
import pyarrow as pa
import pytest

from loomgrid.llm import bpe, common, fingerprint, kernels, language_id, license_scan, quality, queries, secret_scan
from loomgrid.llm.automaton import Automaton

EDGE = [None, "", " ", "a", "A a A", "é ñ", "x" * 50_000, "word " * 20_000, "\n\n", "!!! ###", "日本語"]


def frame(spark, texts, first=0):
    """Texts with columns whose names the operators use themselves."""
    rows = [(first + i, t, "k", "n", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, ids string, score int").repartition(3)


# kernels


def test_shingles_equal_python(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab AB\t\n\x0bé") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["a" * 5000, "a b " * 2000]
    buf, offs = common.text_bytes(pa.array(texts))
    whole = kernels.word_hashes(buf, offs)
    monkeypatch.setattr(kernels, "PART", 64)
    assert all((x == y).all() for x, y in zip(whole, kernels.word_hashes(buf, offs), strict=True))
    seen = {}
    for text, got in zip(texts, kernels.shingle_sets(buf, offs, 3), strict=True):
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", text.replace("A", "a").replace("B", "b"))]
        want = {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()
        assert len(want) == len(got)
        for s in want:
            seen.setdefault(s, set(got.tolist()))
            seen[s] &= set(got.tolist())
    assert all(seen.values())  # a shingle has the same hash in every text


# byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_equals_the_library(spark, tokenizer):
    rng = random.Random(2)
    pool = [chr(c) for c in range(0x2FFFF) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    base = list("ab cd's't 're  \t\n\r\x1c\x85\xa0 　½²Ⅷé'll!?.,") + ["<|endoftext|>", "aaaa", "the "]
    texts = EDGE + ["".join(rng.choice(base) for _ in range(rng.randint(0, 40))) for _ in range(600)] + ["".join(rng.choice(pool) for _ in range(30)) for _ in range(600)]
    got = {r.doc_id: r for r in bpe.encode(frame(spark, texts), queries.tokenizer_path(), decoded=True).collect()}
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids, repr(text)
        assert got[i].decoded == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.encode(frame(spark, ["a"]).limit(0), queries.tokenizer_path()).collect() == []


def test_long_texts_in_parts(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 50)
    own = bpe.Encoder(bpe.Vocabulary(queries.tokenizer_path()))
    rng = random.Random(5)
    for _ in range(50):
        text = "".join(rng.choice([" a", "bc d", "  ", "x", "é ", "<|endoftext|>", "'s t", "1 2", ". q"]) for _ in range(200))
        assert own.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_decode_of_any_ids(spark, tokenizer):
    rng = random.Random(3)
    lists = [[rng.randrange(50257) for _ in range(rng.randint(0, 20))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate([*lists, None])), "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(df, queries.tokenizer_path()).collect()}
    assert got == {i: tokenizer.decode(x or [], skip_special_tokens=False) for i, x in enumerate([*lists, None])}


# language identification


def test_languages(spark):
    rng = random.Random(4)
    syllables = {"xx": ["ka", "to", "mi", "ra"], "yy": ["sch", "ung", "ein", "ich"], "zz": ["ção", "lh", "nh", "que"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(lang := rng.choice(list(syllables)), 30), lang, "s", i) for i in range(300)]
    mixed = make("xx", 60) + " " + make("yy", 25)
    rows += [(1000 + i, t, None, "s", 0) for i, t in enumerate([*EDGE, mixed])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    held = [r for r in rows if r[2] and got[r[0]].held_out]
    assert held and all(got[r[0]].lang_pred == r[2] for r in held)
    for i, text in enumerate(EDGE):
        none = not any(c.isalpha() for c in text or "")
        assert (got[1000 + i].lang_pred == "und") == none
        assert 0 <= got[1000 + i].score <= 1 and (not none or got[1000 + i].score == 0)
    both = got[1000 + len(EDGE)]
    assert both.lang_pred == "xx" and 0.55 < both.score < 0.85  # the mixture's share
    kept = language_id.keep_languages(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.lang_pred != "und"}
    none = language_id.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null"))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).collect() == []


def test_long_texts_are_read_in_parts(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab cdé .\n") for _ in range(rng.choice([0, 5, 40, 900]))) for _ in range(60)] + ["x" * 500, "a b " * 300]
    buf, offs = common.text_bytes(pa.array(texts))
    model = language_id.Mixture(["a", "b"], np.random.default_rng(1).random((2, language_id.BUCKETS)) * 50)
    whole, first = model.words(buf, offs)
    stats = quality.statistics(buf, offs)
    for module, name in ((language_id, "PART"), (quality, "BYTES"), (kernels, "PART")):
        monkeypatch.setattr(module, name, 37)
    parts, again = model.words(buf, offs)
    assert (first == again).all() and np.abs(whole - parts).max() < 1e-4
    assert np.abs(stats - quality.statistics(buf, offs)).max() < 1e-12


def test_language_sets_grow_to_all_languages(spark):
    rng = random.Random(8)
    syllables = {"aa": ["ka", "to", "mi"], "bb": ["sch", "ung", "ein"], "cc": ["pr", "olf", "ew"], "dd": ["zy", "vx", "qu"], "ee": ["nn", "hh", "gg"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    names = list(syllables)
    texts = [make(names[i % 5], 30) for i in range(200)]
    docs = spark.createDataFrame([(i, t, names[i % 5]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    mixed = [" ".join(make(x, 20 * (m - at)) for at, x in enumerate(names[:m])) for m in range(1, 6)]
    asked = spark.createDataFrame(list(enumerate([*mixed, None, "12"])), "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(asked, language_id.train(docs)).collect()}
    for m in range(1, 6):
        r = got[m - 1]
        assert r.langs == names[:m] and r.lang_pred == "aa" and r.score == r.proportions[0]
        assert np.abs(np.array(r.proportions) - np.arange(m, 0, -1) * 2 / (m * (m + 1))).max() < 0.02
    assert all(got[i].langs == [] and got[i].lang_pred == "und" and got[i].score == 0 for i in (5, 6))


def test_keep_languages_by_evidence(spark):
    rng = random.Random(9)
    syllables = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ein", "ich"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    clean = [(i, make(lang := "ab"[i % 2] * 2, rng.choice([3, 30, 400])), lang) for i in range(600)]
    noise = ["".join(rng.choice("bcdfghjlpqvwxyz") for _ in range(900)), " ".join("".join(rng.choice("bdfgjlpqvwxyz") for _ in range(7)) for _ in range(90))]
    docs = spark.createDataFrame([*clean, *((1000 + i, t, None) for i, t in enumerate([*noise, "12 34", "", None]))], "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.keep_languages(docs).collect()} == {r[0] for r in clean}


def test_keep_languages_without_a_language(spark):
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(EDGE)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.keep_languages(docs).collect()} == {i for i, t in enumerate(EDGE) if any(c.isalpha() for c in t or "")}


# fingerprints


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] or sets[1] else 1.0


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_fingerprints(spark, partitions):
    rng = random.Random(5)
    texts = [t for t in EDGE if t not in ("日本語",)] + [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 300))) for _ in range(150)]
    texts[20] = texts[21]
    ids = rng.sample(range(-50, 10_000), len(texts))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(i, t, True, 0) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, tail boolean, bucket int")
        got = {r.doc_id: r for r in fingerprint.edited_fingerprints(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = sorted(((i, t or "") for i, t in zip(ids, texts, strict=True)), reverse=True)
    assert len(got) == len(rows)
    errors = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    assert got[ids[20]].fingerprint == got[ids[21]].fingerprint


def test_fingerprint_of_one_and_none(spark):
    one = frame(spark, ["a b c d e f g"])
    assert [r.near_next for r in fingerprint.edited_fingerprints(one).collect()] == [1.0]
    assert fingerprint.edited_fingerprints(one.limit(0)).collect() == []
    assert [r.fingerprint for r in fingerprint.fingerprint(frame(spark, [None, ""])).collect()] == ["", ""]
    repeated = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, None)], "doc_id long, text string")
    assert len(fingerprint.edited_fingerprints(repeated).collect()) == 4


# quality


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(80)) + "."
    bad = lambda: " ".join(rng.choice(["###", "$$$", "%%%"]) + "ab" for _ in range(80))
    truth = [int(rng.random() < 0.8) for _ in range(900)]
    rows = [(i, good() if q else bad(), "a") for i, q in enumerate(truth)]
    docs = spark.createDataFrame(rows + [(5000 + i, t, "a") for i, t in enumerate(EDGE)], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(truth) if i % 2] + [(1, truth[1], 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [i for i in range(900) if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values()) and len(got) == 900 + len(EDGE)
    assert {r.score for r in quality.classify(docs.limit(5), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize(("documents", "labelled"), [(2000, 1500), (20_000, 150)])
def test_quality_samples_labels_apart(spark, monkeypatch, documents, labelled):
    docs = spark.createDataFrame([(i, "word " * (i % 7 + 1)) for i in range(documents)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(labelled)] + [(10**6, 1), (None, 1), (8, None)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "SAMPLE", 400)
    monkeypatch.setattr(quality, "learn", lambda p, u: seen.append((len(p), len(u))))
    quality.train(docs, labels)
    (positive, unlabelled), = seen
    assert positive == labelled * 3 // 4 if labelled < 400 else 300 < positive < 500
    assert 300 < unlabelled < 500


def test_class_prior():
    rng = np.random.default_rng(2)
    draw = lambda good, n: np.column_stack([rng.normal(2.5 * good, 1, n), rng.normal(0, 1, n)])
    for prior in (0.2, 0.5, 0.85):
        n = 8000
        unlabelled = np.concatenate([draw(1, int(n * prior)), draw(0, n - int(n * prior))])
        rng.shuffle(unlabelled)
        assert abs(quality.class_prior(draw(1, 4000), unlabelled) - prior) < 0.06


def test_quality_of_null_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "k"), (1, "a b", "k"), (None, "a b", "k"), (2, None, "k"), (3, "x " * 400_000, "k")], "doc_id long, text string, key string")
    labels = spark.createDataFrame([(1, 1, "g"), (2, 0, "g")], "doc_id long, quality int, good string")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id in (1, None)}) == 1


# licences


def licence(text):
    x = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x)
    places, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    every, best, rare = set(labels), 0.0, license_scan.rare_words()
    for t, (label, template, phrase) in enumerate(license_scan.TEMPLATES):
        words = template.split()
        if f" {phrase} " not in f" {' '.join(w)} ":
            continue
        looked_up = [x for x in rare[t] if x in w][: license_scan.LOOKED_UP]
        for o in range(1 - len(words), len(w)):
            ok = [0 <= o + q < len(w) and w[o + q] == words[q] for q in range(len(words))]
            share = sum(ok) / len(words)
            if share >= license_scan.IN_PLACE and sum(ok[q] for q in range(len(words)) if words[q] in looked_up) >= 2:
                every.add(label)
                best = max(best, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(every)), best


def test_licences(spark):
    rng = random.Random(7)
    parts = [p for p, _ in license_scan.BASE] + [t for _, t, _ in license_scan.TEMPLATES] + ["MIT", "License", "cc", "by", "é", "CC BY-NC 4.0", "Mit der", "GNU  General.Public-License", "K", "x"]
    texts = [t for t in EDGE if len(t or "") < 1000] + [rng.choice([" ", ", ", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    got = {r.doc_id: tuple(r)[1:8] for r in license_scan.scan(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        assert got[i] == licence(text), repr(text)
    long = "license " * 100_000 + "mit license"
    r = license_scan.scan(frame(spark, [long])).first()
    assert (r.n_words, r.n_base, r.first_word) == (100_002, 1, 100_000)
    assert license_scan.scan(frame(spark, ["a"]).limit(0)).collect() == []


def test_licences_with_other_words_and_repeated_rows(spark):
    label, whole, _ = license_scan.TEMPLATES[12]
    words = whole.split()
    rare = [w for w in license_scan.rare_words()[12]][:3]  # the rarest words are misspelt in the file
    text = " ".join("xx" if w in rare else w for w in words)
    assert sum(w in rare for w in words) < len(words) / 10
    df = spark.createDataFrame([(1, text, "k", 0), (1, text, "k", 0), (None, text, "k", 0)], "doc_id long, text string, _key string, _n int")
    assert [(r.labels, r.found[0].start) for r in license_scan.scan(df).collect()] == [(label, 0)] * 3
    with pytest.raises(ValueError):
        license_scan.scan(df, templates=license_scan.TEMPLATES[:1] * 2000)


# secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    for k, rule in enumerate(secret_scan.RULES[3:], 3):
        out += [(m.start(), k, m.end()) for m in re.finditer(rule.pattern, text) if rule.keep is None or rule.keep(m[0].encode())]
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(8)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "apikey", "_", " ", ":", "=", "'", '"', "abc", "123456", "é", "AKIA", "A" * 8, "0af" * 9, "f", "\n", ",", "x.y-z", "ghp_" + "a1" * 18, "eyJ" + "x" * 8, "eyJ", "." + "y" * 8, "xoxb-1234567890", "-----BEGIN RSA PRIVATE KEY-----", "ſ", "K"]
    texts = EDGE + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["a" * 30_000 + " token = abcdef"]
    docs = frame(spark, texts)
    kinds = [r.kind for r in secret_scan.RULES]
    got = {r.doc_id: [(s.start, kinds.index(s.kind), s.end) for s in r.spans] for r in secret_scan.find_secrets(docs).collect()}
    for i, text in enumerate(texts):
        assert got[i] == secrets(text), repr(text)
    clean = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    for i, text in enumerate(texts):
        if not secrets(text):
            assert clean[i].text == text
    some = spark.createDataFrame([(1, "my token=abcdef12 and", 21, None)], "doc_id long, text string, n_chars long, spans string")
    assert [tuple(r) for r in secret_scan.redact(some).collect()] == [(1, "my <assign> and", 15, None)]
    assert secret_scan.find_secrets(docs.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("eyJ" * 350_000 + "." + "0af" * 9, [(1_050_001, 2, 1_050_028)]),
        ("token=" * 150_000, [(0, 0, 900_000)]),
        ("AKIA" * 250_000, [(0, 1, 1_000_000)]),
        ("0a" * 400_000, [(0, 2, 800_000)]),
        ("xoxb-" * 200_000 + ".", [(0, 4, 1_000_000)]),
        ("-----BEGIN " * 90_000, []),
        ("eyJa." * 100_000, []),
    ],
)
def test_secrets_take_linear_time(text, want):
    began = time.time()
    assert secret_scan.scanner_of(secret_scan.RULES).scan(*common.text_bytes(pa.array([text]))).get(0, []) == want
    assert time.time() - began < 20


def test_secrets_of_long_and_clashing_rows(spark):
    rows = [(1, "secret: " + "x" * 300_000, "a", 7), (1, "secret: " + "x" * 300_000, "b", 8), (None, "hex " + "0f" * 12, "c", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, start int")
    got = sorted((r.doc_id or 0, *((s.kind, s.start, s.end) for s in r.spans)) for r in secret_scan.find_secrets(docs).collect())
    assert got == [(0, ("hex", 4, 28)), (1, ("assign", 0, 300_008)), (1, ("assign", 0, 300_008))]
    assert sorted((r.doc_id or 0, r.text, r.spans, r.start) for r in secret_scan.redact(docs).collect()) == [(0, "hex <hex>", "c", 9), (1, "<assign>", "a", 7), (1, "<assign>", "b", 8)]


def test_secrets_in_parts(monkeypatch):
    rng = random.Random(10)
    texts = ["".join(rng.choice(["token=abcdef1", "é", "\n", ",", "word ", "0af" * 9, "AKIA" + "B" * 17]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    scanner = secret_scan.Scanner()
    buf, offs = common.text_bytes(pa.array(texts))
    whole = scanner.scan(buf, offs)
    monkeypatch.setattr(secret_scan, "PART", 40)
    assert scanner.scan(buf, offs) == whole == {i: s for i, t in enumerate(texts) if (s := secrets(t))}


@pytest.mark.parametrize("pattern", ["a(b|c)*d", "[a-c]{2,4}x?", "(ab|a)(bc|c)?", "[^a]b+", "a{3}", r"\x61\.b", ".b"])
def test_automaton_equals_re(pattern):
    own, other = Automaton([(pattern, False)], False), re.compile(pattern.encode())
    rng = random.Random(9)
    for _ in range(400):
        s = bytes(rng.choice(b"abcdx.\n") for _ in range(rng.randint(0, 7)))
        state = own.start
        for b in s:
            state = own.table[state, own.classes[b]]
        assert bool(own.accepts[state]) == bool(other.fullmatch(s)), s
