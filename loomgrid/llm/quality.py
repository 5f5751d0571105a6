"""Quality classification by positive-unlabelled learning.

Trusted positives are rows labelled 1; unlabelled rows are a bounded sample of all web text, whatever
their labels. Labels 0 are not used, but that an id with one is no trusted positive. A logistic model
over binned text statistics minimises the non-negative unbiased risk: prior * risk of positives as 1,
plus the larger of 0 and the risk of unlabelled rows as 0 less prior * the risk of positives as 0. The
class prior is estimated from the two samples alone: of all thresholds of a first model, fitted to half
of the rows, the one at which the unlabelled rows of the other half are scarcest beside the positives,
within the error that samples of their sizes allow (best-bin estimation). The intercept is then set so
that the share of the unlabelled sample that scores THRESHOLD or more is the prior.

Bounds: SAMPLE positives and SAMPLE documents of all, in expectation (by a hash of the id, whole texts)
are read for training, so labels that cover a small part of a large table all count; only their
statistics, a few numbers each, reach the driver. Scores read only the text. Defined cases: null and
empty texts are scored by their (zero) statistics; texts of any length are read whole, in parts; equal
texts have equal scores; labels of ids that no document has, and null labels or ids, are not used;
without a labelled positive all scores are 0.5; an empty table gives no rows; repeated rows are scored
each; other columns are not used, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import held_out, pieces, text_bytes

SAMPLE = 40_000
BINS = 12
STEPS, RATE, RIDGE = 600, 0.05, 1e-3
#: Steps of the first model; chance that the bound of the prior fails, and what it weighs; the prior's range.
FIRST_STEPS, FAIL, SLACK, LEAST_PRIOR, MOST_PRIOR = 200, 0.1, 1.01, 0.05, 0.98
THRESHOLD = 0.3
_U64 = np.uint64
_KIND = np.zeros(256, np.int64)  # 0 other, 1 small letter, 2 capital, 3 digit, 4 white space, 5 sentence mark, 6 other mark, 7 above 127
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[32, *range(9, 14)]] = 4
_KIND[[ord(c) for c in ".,;:'\"-?()"]] = 5
_KIND[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_KIND[128:] = 7
_BLANK = b" \t\x0b\x0c\r"
_ENDS = np.isin(np.arange(256), (33, 46, 63))
BYTES = 1 << 20  # counted at once; a longer text is counted in parts
NAMES = ("log_bytes", "log_words", "capitals", "digits", "blank", "marks", "symbols", "high", "word_length", "distinct_words", "most_frequent", "distinct_pairs", "repeated_next", "lines", "distinct_lines", "line_words", "sentence_words", "short_words")


def byte_counts(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of each kind, sentence ends and line ends of each row."""
    n = len(offs) - 1
    kinds, ends, lines = np.zeros(8 * n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for lo in range(0, len(buf), BYTES):
        part = buf[lo : lo + BYTES]
        row = np.searchsorted(offs, np.arange(lo, lo + len(part)), "right") - 1
        kinds += np.bincount(row * 8 + _KIND[part], minlength=8 * n)
        ends += np.bincount(row[_ENDS[part]], minlength=n)
        lines += np.bincount(row[part == 10], minlength=n)
    return kinds.reshape(n, 8), ends, lines


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """NAMES of each row; all zero for an empty one."""
    n = len(offs) - 1
    out = np.zeros((n, len(NAMES)))
    size = np.diff(offs).astype(float)
    kinds, ends, lines = byte_counts(buf, offs)
    words, first = kernels.word_hashes(buf, offs)
    count = np.diff(first)
    some = np.maximum(count, 1)
    lines = lines + (size > 0)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(count)
    for c, k in ((2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7)):
        out[:, c] = kinds[:, k] / np.maximum(size, 1)
    out[:, 8] = (size - kinds[:, 4]) / some
    follow = np.zeros(len(words), bool)
    follow[1:] = words[1:] == words[:-1]
    follow[first[:-1][first[:-1] < len(words)]] = False
    out[:, 12] = np.bincount(np.repeat(np.arange(n), count), weights=follow, minlength=n) / some
    pairs = words.copy()
    pairs[:-1] = pairs[:-1] * _U64(0x9E3779B97F4A7C15) + words[1:]
    for d in np.flatnonzero(count):
        w = np.sort(words[first[d] : first[d + 1]])
        runs = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1], [True]]))
        out[d, 9] = (len(runs) - 1) / count[d]
        out[d, 10] = np.diff(runs).max() / count[d]
        out[d, 11] = len(np.unique(pairs[first[d] : first[d + 1] - 1])) / max(1, count[d] - 1)
        own = buf[offs[d] : offs[d + 1]].tobytes().translate(kernels.FOLD, _BLANK).split(b"\n")
        out[d, 14] = len(set(own)) / len(own)
    out[:, 13] = np.log1p(lines)
    out[:, 15] = count / np.maximum(lines, 1)
    out[:, 16] = count / np.maximum(ends, 1)
    out[:, 17] = (count < 20) * (count > 0)
    return out


class Model:
    """A logistic model over bins of the statistics."""

    def __init__(self, cuts: list[np.ndarray] = (), weights: np.ndarray | None = None):
        self.cuts, self.weights = cuts, weights

    def bins(self, x: np.ndarray) -> np.ndarray:
        """The places of a row's weights: a constant and one bin of each statistic."""
        out = np.zeros((len(x), 1 + len(self.cuts)), np.int64)
        for k, cut in enumerate(self.cuts):
            out[:, 1 + k] = 1 + k * BINS + np.searchsorted(cut, x[:, k], "right")
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int | None = None) -> Model:
    """Minimise the non-negative unbiased risk with the logistic loss by Adam over all rows."""
    if not len(positive) or not len(unlabelled):
        return Model()
    model = Model([np.unique(np.quantile(unlabelled[:, k], np.arange(1, BINS) / BINS)) for k in range(unlabelled.shape[1])])
    p, u = model.bins(positive), model.bins(unlabelled)
    size = 1 + len(model.cuts) * BINS
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)

    def mean(rows: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        """The gradient of a mean over rows with these slopes."""
        return np.bincount(rows.ravel(), np.repeat(slopes, rows.shape[1]), size) / len(rows)

    for step in range(1, (steps or STEPS) + 1):
        ps, us = 1 / (1 + np.exp(-w[p].sum(1))), 1 / (1 + np.exp(-w[u].sum(1)))
        negative = -np.log(np.maximum(1 - us, 1e-12)).mean() + prior * np.log(np.maximum(1 - ps, 1e-12)).mean()
        as_zero = mean(u, us) - prior * mean(p, ps)
        # below 0 the risk of negatives is driven back up
        grad = RIDGE * w + (prior * mean(p, ps - 1) + as_zero if negative >= 0 else -as_zero)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights = w
    return model


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows, by the best bin of a model of every other row."""
    first = fit(positive[::2], unlabelled[::2], 0.5, FIRST_STEPS)
    rest_p, rest_u = positive[1::2], unlabelled[1::2]
    if first.weights is None or not len(rest_p) or not len(rest_u):
        return 0.5
    at_p, at_u = np.sort(first.margin(rest_p)), np.sort(first.margin(rest_u))
    cuts = np.unique(at_p)
    of_p, of_u = (1 - np.searchsorted(x, cuts, "left") / len(x) for x in (at_p, at_u))
    error = np.sqrt(np.log(4 / FAIL) / 2) * (len(at_u) ** -0.5 + len(at_p) ** -0.5)
    best = np.argmin((of_u + SLACK * error) / of_p)
    return float(np.clip(of_u[best] / of_p[best], LEAST_PRIOR, MOST_PRIOR))


def learn(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """The model of two samples, with a decision at THRESHOLD that the prior's share of unlabelled rows passes."""
    prior = class_prior(positive, unlabelled)
    model = fit(positive, unlabelled, prior)
    if model.weights is not None:
        cut = np.quantile(model.margin(unlabelled), 1 - prior)
        model.weights[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - cut
    return model


def _statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            for i, j in pieces(offs):
                x = statistics(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * len(NAMES)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["key", "x"])

    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(run, f"key {kind}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> Model:
    """Fit on documents and labels of which held-out rows must already be gone."""
    ids = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marks = labels.where(F.col(quality).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(quality).alias("least")).where("least = 1").select("key")
    total = docs.count()
    good = ids.select("key").join(marks, "key", "left_semi").count()
    if not good:
        return Model()
    below = lambda n: F.lit(int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))
    place = lambda seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30))
    # about SAMPLE keys, as only keys of documents are drawn
    drawn = F.broadcast(marks.where(place(3) < below(good)).join(ids.select("key"), "key", "left_semi").withColumn("good", F.lit(True)))
    any_ = place(2) < below(total)
    read = ids.join(drawn, "key", "left").where(any_ | F.col("good")).select(F.struct("key", any_.alias("any"), "good").alias("of"), "text")
    rows = _statistics(read, "of", "text").select("x", "key.any", F.coalesce("key.good", F.lit(False)).alias("good")).toPandas()
    if not len(rows):
        return Model()
    x = np.array(rows["x"].tolist())
    return learn(x[rows["good"].to_numpy(bool)], x[rows["any"].to_numpy(bool)])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of each text. No shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            buf, offs = text_bytes(batch.column(1))
            for i, j in pieces(offs):
                value = model.score(statistics(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(value, pa.float64())], ["key", "score"])

    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of a documents table, with a model of the rows that are not held out."""
    kept = ~held_out(F.col("doc_id"))
    model = train(docs.where(kept), labels.where(kept))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
