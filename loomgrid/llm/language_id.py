"""Language identification by inference of multilingual mixtures.

Training counts byte trigrams inside words for each language, on a bounded sample of the labelled
rows. For a document, the likelihood of each word under each language comes from its trigrams;
expectation-maximisation over the words, until no proportion moves by TOLERANCE, gives the document's
language proportions. Sets of the one, two, ... most likely languages, each with its own proportions,
are compared by their likelihood less half a logarithm of the words for each further proportion (BIC):
all of up to FIRST_SETS languages, and larger ones as long as the largest so far is the best. The chosen
set is given with its proportions; the largest is the prediction, its share the score.

Bounds: SAMPLE labelled rows for each language (their expected number; chosen by a hash of the id,
whole texts), BUCKETS trigram counters for each language. Every language of the labels is learnt; more
than LANGUAGES of them, whose model would not fit a worker, are an error. Prediction reads only the
text. Defined cases: null, empty and letterless texts are `und` with score 0; without any labelled row
all are; texts of any length are read whole, in parts that end with a word; ties go to the first
language by name; an empty table gives no rows; repeated rows are predicted each and null ids are kept;
other columns are not used, whatever their names, and `keep_languages` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, pieces, text_bytes

SAMPLE, LANGUAGES, BUCKETS = 3000, 4096, 1 << 14
SMOOTH = 0.5
PART = 1 << 18  # bytes of a text read at once, for up to MANY languages
MANY = 16
ROUNDS, TOLERANCE, FIRST_SETS = 100, 1e-3, 3
#: The evidence is the log-likelihood ratio of the chosen mixture and a background of equal buckets for each trigram, drawn
#: to 0 by FEW more trigrams. Texts of sf0.1 are above 0, letter noise is below -3; a text below LEAST is in no learnt language.
FEW, LEAST = 16, -2.0
_U32 = np.uint32
#: Letters keep their (small) byte, all others become a space; bytes above 127 count as letters.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around every letter byte, the trigrams' word starts, and the words before each row."""
    n = len(offs) - 1
    wide = np.full(len(buf) + n + 1, 32, np.uint8)  # a space before and after each row
    row = np.repeat(np.arange(n), np.diff(offs))
    wide[np.arange(len(buf)) + row + 1] = _FOLD[buf]
    letter = wide != 32
    at = np.flatnonzero(letter)
    code = wide.astype(_U32)
    gram = (code[at - 1] << _U32(16) | code[at] << _U32(8) | code[at + 1]) * _U32(2654435761)
    starts = np.flatnonzero(~letter[at - 1])
    first = np.searchsorted(at[starts], offs + np.arange(n + 1))
    return (gram >> _U32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), starts, first


def subset(rows: np.ndarray, like: np.ndarray, heads: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some rows: likelihoods, first words, sizes, and the row of each word."""
    among = np.zeros(len(heads), bool)
    among[rows] = True
    size = size[rows]
    return like[among[of]], np.cumsum(size) - size, size, np.repeat(np.arange(len(rows)), size)


def climb(pi: np.ndarray, like: np.ndarray, heads: np.ndarray, size: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The proportions [row, language] that expectation-maximisation climbs to, and the log-likelihood of each row. Zeros stay; rows that have settled are left alone."""
    out, rows, words = pi.copy(), np.arange(len(pi)), (like, heads, size, of)
    for step in range(1, ROUNDS + 1):
        part = words[0] * pi[words[3]]
        part /= part.sum(1, keepdims=True)
        new = (np.add.reduceat(part, words[1], axis=0) / words[2][:, None]).astype(np.float32)
        moved = np.abs(new - pi).max(1) >= TOLERANCE
        pi = new
        if step in (1, 2, 4) or not step % 8 or step == ROUNDS or not moved.any():
            out[rows] = pi
            rows, pi = rows[moved], pi[moved]
            if not len(rows):
                break
            words = subset(np.flatnonzero(moved), *words)
    return out, np.add.reduceat(np.log(np.maximum((like * out[of]).sum(1), 1e-38)), heads)


class Mixture:
    """Log-likelihoods of trigrams [bucket, language]."""

    def __init__(self, names: list[str], counts: np.ndarray):
        total = counts + SMOOTH
        self.names = names
        self.log = np.log(total / total.sum(1, keepdims=True)).T.astype(np.float32)

    def part(self) -> int:
        """Bytes to read at once: fewer with many languages."""
        return max(32, PART * MANY // max(MANY, len(self.names)))

    def words(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of all words under each language, and the words before each row; a long row is read in parts that end with a word."""
        found, first, n = [np.zeros((0, len(self.names)), np.float32)], np.zeros(len(offs), np.int64), 0

        def read(own: np.ndarray, edges: np.ndarray) -> np.ndarray:
            grams, starts, at = trigrams(own, edges)
            if len(starts):
                found.append(np.add.reduceat(self.log[grams], starts, axis=0, dtype=np.float32))
            return at

        part = self.part()
        for i, j in pieces(offs, part):
            lo, hi = int(offs[i]), int(offs[j])
            if j > i + 1 or hi - lo <= 2 * part:
                at = read(buf[lo:hi], offs[i : j + 1] - lo)
                first[i + 1 : j + 1] = n + at[1:]
                n += int(at[-1])
                continue
            while lo < hi:
                to = min(hi, lo + part)
                while to < hi and not len(gap := np.flatnonzero(_FOLD[buf[to : min(hi, to + part)]] == 32)):
                    to = min(hi, to + part)
                if to < hi:
                    to += int(gap[0])
                n += int(read(buf[lo:to], np.array([0, to - lo]))[-1])
                lo = to
            first[j] = n
        return np.concatenate(found), first

    def infer(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row the index of its language (-1: no letter), the proportions of the chosen set, 0 outside it, and its evidence."""
        n, k = len(offs) - 1, len(self.names)
        words, first = self.words(buf, offs)
        count = np.diff(first)
        best, shares, evidence = np.full(n, -1), np.zeros((n, k), np.float32), np.zeros(n)
        rows = np.flatnonzero(count)
        if not len(rows) or not k:
            return best, shares, evidence
        top = words.max(1, keepdims=True)
        like = np.exp(np.maximum(words - top, -60))
        heads, size = first[:-1][rows], count[rows]
        of = np.repeat(np.arange(len(rows)), size)

        whole = (like, heads, size, of)
        pi, _ = climb(np.full((len(rows), k), 1 / k, np.float32), *whole)
        order = np.argsort(-pi, axis=1, kind="stable")
        score = np.full(len(rows), -np.inf)
        chosen, under = np.zeros_like(pi), np.zeros(len(rows))
        left, own = np.arange(len(rows)), whole  # rows for which a larger set is tried
        for m in range(1, k + 1):
            within = np.zeros((len(left), k), np.float32)
            np.put_along_axis(within, order[left, :m], 1.0, 1)
            start = np.maximum(pi[left], 1e-6) * within
            part, fit = climb(start / start.sum(1, keepdims=True), *own)
            worth = fit - (m - 1) / 2 * np.log(size[left])
            better = worth > score[left]
            under[left[better]], score[left[better]], chosen[left[better]] = fit[better], worth[better], part[better]
            if m >= FIRST_SETS:
                left = left[better]
                if not len(left):
                    break
                own = subset(left, *whole)
        best[rows], shares[rows] = chosen.argmax(1), np.clip(chosen, 0, 1)
        grams = np.diff(np.concatenate([[0], np.cumsum(_FOLD[buf] != 32)])[offs])[rows]
        evidence[rows] = (under + np.add.reduceat(top[:, 0].astype(float), heads) + grams * np.log(BUCKETS)) / (grams + FEW)
        return best, shares, evidence


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Mixture:
    """Counts trigrams of a bounded sample of labelled rows. At most LANGUAGES * BUCKETS counters reach the driver."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r["l"]: r["n"] for r in rows.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    names = sorted(sizes)
    if not names:
        return Mixture([], np.zeros((0, BUCKETS)))
    rate = F.create_map(*(x for name in names for x in (F.lit(name), F.lit(min(1.0, SAMPLE / sizes[name])))))
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(1 << 30)) < F.try_element_at(rate, F.col(lang)) * float(1 << 30)
    at = {name: i for i, name in enumerate(names)}

    def count(batches):
        total = np.zeros((len(names), BUCKETS), np.int64)
        for batch in batches:
            langs = np.array([at[x] for x in batch.column(0).to_pylist()], np.int64)
            buf, offs = text_bytes(batch.column(1))
            for i, j in pieces(offs):
                grams, _, _ = trigrams(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                lengths = np.add.reduceat(np.append(_FOLD[buf[offs[i] : offs[j]]] != 32, False).astype(np.int64), np.minimum(offs[i:j] - offs[i], offs[j] - offs[i]))
                lengths[np.diff(offs[i : j + 1]) == 0] = 0
                total += np.bincount(np.repeat(langs[i:j], lengths) * BUCKETS + grams, minlength=total.size).reshape(total.shape)
        who, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(bucket), pa.array(total[who, bucket])], ["lang", "bucket", "n"])

    found = rows.where(drawn).select(lang, text).mapInArrow(count, "lang bigint, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(names), BUCKETS))
    counts[found["lang"].to_numpy(np.int64), found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return Mixture(names, counts)


def lettered(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each row has a letter."""
    plain = np.zeros(256, bool)
    plain[65:91] = plain[97:123] = True
    out = np.diff(np.concatenate([[0], np.cumsum(plain[buf])])[offs]) > 0
    high = np.diff(np.concatenate([[0], np.cumsum(buf > 127)])[offs]) > 0
    for r in np.flatnonzero(~out & high):  # only bytes above 127: are they letters?
        out[r] = any(c.isalpha() for c in buf[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predicted(model: Mixture, buf: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The predicted language of each row (`und` without a letter) and the proportions of its set."""
    best, shares, _ = model.infer(buf, offs)
    none = ~lettered(buf, offs)
    best[none], shares[none] = -1, 0.0
    return [model.names[x] if x >= 0 else "und" for x in best], shares


def predict(docs: DataFrame, model: Mixture, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, and the chosen set: langs, by falling share, and their proportions. No shuffle; the model has a fixed bound and travels with the tasks."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            for i, j in pieces(offs, own.part()):
                names, shares = predicted(own, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                order = np.argsort(-shares, axis=1, kind="stable")
                some = np.take_along_axis(shares, order, 1) > 0
                edges = pa.array(np.concatenate([[0], np.cumsum(some.sum(1))]).astype(np.int32))
                langs = pa.ListArray.from_arrays(edges, pa.array([own.names[x] for x in order[some]], pa.string()))
                part = pa.ListArray.from_arrays(edges, pa.array(np.take_along_axis(shares, order, 1)[some].astype(float)))
                score = pa.array(shares.max(1, initial=0).astype(float))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), score, langs, part], ["key", "lang_pred", "score", "langs", "proportions"])

    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(run, f"key {kind}, lang_pred string, score double, langs array<string>, proportions array<double>").withColumnRenamed("key", key)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of a documents table, trained on its rows that are not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_languages(docs: DataFrame, rejected: tuple[str, ...] = ("und",), least: float = LEAST) -> DataFrame:
    """The documents with a letter whose predicted language is not rejected and has enough evidence, with their columns; a row passes on its own text.

    Where no language could be learnt, all texts with a letter stay."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    shared = docs.sparkSession.sparkContext.broadcast((model, frozenset(rejected)))
    at = docs.columns.index("text")

    def run(batches):
        own, out = shared.value
        gone = np.array([x in out for x in own.names] + [False], bool)  # the last: none predicted
        for batch in batches:
            texts = batch.column(at)
            buf, offs = text_bytes(texts.fill_null("") if texts.null_count else texts)
            for i, j in pieces(offs, own.part()):
                part, edges = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                best, _, evidence = own.infer(part, edges)
                stay = (evidence >= least) & ~gone[best]
                if "und" in out:
                    stay &= lettered(part, edges)
                yield batch.slice(i, j - i).filter(pa.array(stay, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
