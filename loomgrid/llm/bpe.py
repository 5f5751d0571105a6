"""Byte-level BPE encoding and decoding with an index of pair occurrences.

All distinct words of a batch lie in one symbol array with links to the next and the previous
symbol. An index maps the rank of each mergeable pair to all its positions; active ranks are
taken in ascending order, every position of a rank is merged at once, and the pairs that the
merge makes are looked up and appended to the lists of their ranks. Words seen before come from
a bounded cache of the worker.

Defined cases: null and empty texts have no tokens and decode to the empty text; a long text is encoded
in parts that end where no word goes on, so its ids are those of the whole; of overlapping pairs of one
rank the left one is merged; repeated rows are encoded each; null ids are kept; an empty table gives no
rows; other columns are not used, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, text_bytes

#: White space of Unicode, as the pattern's \s.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
CACHED_WORDS = 300_000
CACHED_CHARS = 200
LONG = 1 << 20  # characters of a text that are encoded at once
CUT = regex.compile(r"\p{L} (?=\p{L})|\p{L}(?=[.,;:!?。、，])")
SCALAR = 24  # positions up to which plain Python is faster than numpy


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def long_parts(text: str) -> Iterator[str]:
    """Parts of at most LONG characters or a little more, cut between a letter and a single space before a letter, or a mark, where no word or special token goes on."""
    at = 0
    while len(text) - at > LONG:
        m = CUT.search(text, at + LONG // 2)
        if not m:
            break
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


class Vocabulary:
    """Merges and tokens of a tokenizer file, as arrays; small enough to broadcast (a few MB, fixed by the file)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte, ids = printable_bytes(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.token = [b""] * self.size
        for t, i in ids.items():
            self.token[i] = bytes(byte[c] for c in t)
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.first = np.array([ids[c] for c in sorted(byte, key=byte.get)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int32)
        self.right = np.array([ids[b] for _, b in merges], np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        keys = self.left.astype(np.int64) * self.size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        # merging all positions of a rank at once is the same as one by one only if no merge makes a pair of a lower rank
        last = np.full(self.size, -1, np.int64)
        np.maximum.at(last, self.made, np.arange(len(merges)))
        if (np.maximum(last[self.left], last[self.right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge of the vocabulary uses a token before it is made")

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 without one."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)


class Encoder:
    """Encodes texts with a vocabulary; one lives in each Python worker."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        self.rank = {int(k): int(r) for k, r in zip(vocab.keys, vocab.order, strict=True)}
        self.lengths = np.array([len(t) for t in vocab.token], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(vocab.token), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at, self.used, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), 0, 0

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all words, one after the other, and the offsets of the words."""
        v = self.vocab
        size = np.array([len(w) for w in words], np.int64)
        offs = np.concatenate([[0], np.cumsum(size)])
        sym = v.first[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[offs[1:][size > 0] - 1] = -1
        before[offs[:-1][size > 0]] = -1
        index: dict[int, list] = {}
        heap: list[int] = []

        def post(at: np.ndarray) -> None:
            """Append positions to the lists of their pairs' ranks."""
            r = v.ranks(sym[at], sym[after[at]])
            at, r = at[r >= 0], r[r >= 0]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            heads = np.flatnonzero(np.diff(r, prepend=-1))
            for rank, part in zip(r[heads].tolist(), np.split(at, heads[1:]), strict=True) if len(r) else ():
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(heap, rank)
                index[rank].append(part)

        post(np.flatnonzero(after >= 0))
        rank_of, width = self.rank, v.size
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            a, b, made = int(v.left[rank]), int(v.right[rank]), int(v.made[rank])
            if sum(map(len, parts)) <= SCALAR:
                for p in sorted({int(p) for part in parts for p in part}):
                    q = int(after[p])
                    if sym[p] != a or q < 0 or sym[q] != b:
                        continue
                    sym[p], sym[q], r, l = made, -1, int(after[q]), int(before[p])
                    after[p] = r
                    if r >= 0:
                        before[r] = p
                    for at, x, y in ((l, int(sym[l]), made) if l >= 0 else (-1, 0, 0), (p, made, int(sym[r])) if r >= 0 else (-1, 0, 0)):
                        if at >= 0 and (new := rank_of.get(x * width + y)) is not None:
                            if new not in index:
                                index[new] = []
                                heapq.heappush(heap, new)
                            index[new].append((at,))
                continue
            p = np.unique(np.concatenate([np.asarray(x, np.int64) for x in parts]))
            p = p[(sym[p] == a) & (after[p] >= 0)]
            p = p[sym[after[p]] == b]
            if a == b and len(p) > 1:  # of a run of overlapping pairs every other one is merged, from the left
                head = np.concatenate([[True], after[p[:-1]] != p[1:]])
                step = np.arange(len(p))
                p = p[(step - np.maximum.accumulate(np.where(head, step, 0))) % 2 == 0]
            if not len(p):
                continue
            q = after[p]
            r = after[q]
            sym[p], sym[q], after[p] = made, -1, r
            before[r[r >= 0]] = p[r >= 0]
            l = before[p]
            post(np.unique(np.concatenate([l[l >= 0], p[r >= 0]])))
        left = np.flatnonzero(sym >= 0)
        return sym[left], np.searchsorted(left, offs)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet and keep them."""
        ids, offs = self.merge([w.encode() for w in words])
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(words) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[self.n : self.n + len(words) + 1] = offs + self.used
        self.known.update(zip(words, range(self.n, self.n + len(words)), strict=True))
        self.used, self.n = self.used + len(ids), self.n + len(words)

    def split(self, text: str) -> list[str]:
        """Words of a text; a special token of the vocabulary is a word of its own."""
        if self.cut is None or not self.cut.search(text):
            return self.words.findall(text)
        out = []
        for part in self.cut.split(text):
            out += [part] if part in self.vocab.special else self.words.findall(part)
        return out

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode, but the strings of special tokens are ordinary text."""
        return self.encode(texts, False)

    def encode(self, texts: list[str], special_tokens: bool = True, apart: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all texts, one after the other, and the offsets of the texts."""
        if self.n > CACHED_WORDS:
            self.clear()
        special = self.vocab.special if special_tokens else {}
        if apart and len(texts) == 1 and len(texts[0]) > LONG:
            parts = [self.encode([p], special_tokens, False)[0] for p in long_parts(texts[0])]
            ids = np.concatenate(parts)
            return ids, np.array([0, len(ids)])
        docs = [self.split(t) for t in texts] if special else list(map(self.words.findall, texts))
        new = [w for w in set().union(*docs) if w not in self.known]
        plain = [w for w in new if w not in special]
        self.learn(plain)
        for w in new:
            if w in special:
                self.known[w] = -1 - special[w]
        count = np.array([len(d) for d in docs], np.int64)
        get = self.known.__getitem__
        word = np.fromiter((x for d in docs for x in map(get, d)), np.int64, int(count.sum()))
        real = np.maximum(word, 0)
        start, size = self.at[real], self.at[real + 1] - self.at[real]
        if (word < 0).any():
            size = np.where(word < 0, 1, size)
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        take = np.arange(total) + np.repeat(start - (end - size), size)
        if (word < 0).any():
            ids = self.ids[np.minimum(take, len(self.ids) - 1)]
            ids[(end - size)[word < 0]] = -1 - word[word < 0]
        else:
            ids = self.ids[take]
        if max(map(len, plain), default=0) > CACHED_CHARS:
            self.clear()  # overlong words are not worth their memory
        return ids, np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])]

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of token ids of each text, special tokens as plain text; ids are not put together."""
        if len(texts) == 1 and len(texts[0]) > LONG:
            return sum(self._count([p]) for p in long_parts(texts[0]))
        return self._count(texts)

    def _count(self, texts: list[str]) -> np.ndarray:
        if self.n > CACHED_WORDS:
            self.clear()
        docs = list(map(self.words.findall, texts))
        new = [w for w in set().union(*docs) if w not in self.known]
        self.learn(new)
        ends = np.cumsum([0, *map(len, docs)])
        get = self.known.__getitem__
        word = np.fromiter((x for d in docs for x in map(get, d)), np.int64, int(ends[-1]))
        size = np.concatenate([[0], np.cumsum(self.at[word + 1] - self.at[word])])
        if max(map(len, new), default=0) > CACHED_CHARS:
            self.clear()
        return np.diff(size[ends])

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[str]:
        """The texts of token ids; bytes that are not UTF-8 become U+FFFD."""
        end = np.cumsum(self.lengths[ids])
        parts = []
        for lo in range(0, len(ids), LONG // 4):
            some = ids[lo : lo + LONG // 4]
            size = self.lengths[some]
            to = np.cumsum(size)
            parts.append(self.flat[np.arange(int(to[-1])) + np.repeat(self.starts[some] - (to - size), size)].tobytes())
        raw = b"".join(parts)
        at = np.concatenate([[0], end])[offs].tolist()
        return [raw[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder_of(shared) -> Encoder:
    """This worker's encoder for a broadcast (path, vocabulary)."""
    path, vocab = shared.value
    if path not in _encoders:
        _encoders[path] = Encoder(vocab)
    return _encoders[path]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def broadcast_vocabulary(spark, path: str):
    return spark.sparkContext.broadcast((path, vocabulary(path)))


def text_parts(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch of a few MB, with their second column as strings."""
    _, offs = text_bytes(batch.column(1))
    for i, j in pieces(offs, most):
        part = batch.slice(i, j - i)
        yield part, part.column(1).to_pylist()


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Token ids of each text: key, ids array<int>, and with `decoded` the text that the ids decode to. No shuffle."""
    shared = broadcast_vocabulary(docs.sparkSession, path)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        own = encoder_of(shared)
        for batch in batches:
            for part, texts in text_parts(batch):
                ids, offs = own.encode(texts)
                cols = [part.column(0), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))]
                if decoded:
                    cols.append(pa.array(own.decode(ids, offs), pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["key", "ids", "decoded"][: len(cols)])

    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = source.mapInArrow(run, f"key {kind}, ids array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("key", key)


def count(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and n_tokens of each text, special tokens as plain text. No shuffle."""
    shared = broadcast_vocabulary(docs.sparkSession, path)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        own = encoder_of(shared)
        for batch in batches:
            for part, texts in text_parts(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.count(texts))], ["key", "n_tokens"])

    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The text of each list of token ids: key, text. A null list is empty."""
    shared = broadcast_vocabulary(tokens.sparkSession, path)
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches):
        own = encoder_of(shared)
        for batch in batches:
            lists = batch.column(1)
            offs = np.asarray(lists.offsets, np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.decode(flat, offs - offs[0]), pa.string())], ["key", "text"])

    empty = F.array().cast("array<int>")
    source = tokens.select(F.col(key).alias("key"), F.coalesce(F.col(ids).cast("array<int>"), empty).alias("ids"))
    return source.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
