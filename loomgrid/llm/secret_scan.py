"""Secret scans with one automaton for all rules.

Every byte of every text goes once, from the end to the start, through one minimal automaton of all
reversed rules; after each byte its state says which rules have a match that starts there. Bytes after
which it is in its start state wherever it was (line ends, commas, characters outside all rules) cut
a batch into independent stretches, which advance side by side, one byte of each at a time. Spans are
read off the starts: a second automaton of all rules runs forward from a rule's first start to the
longest end, then from its first start after that. It reads matches only, so the time is linear in
the text. Spans are leftmost, longest and non-overlapping for each kind; those that `keep` refuses
are dropped after that, as the contract of the base kinds has it. No shuffle.

Defined cases: null and empty texts have no spans; texts of any length are scanned whole, in parts that
end where no rule goes on; spans of different kinds may overlap, and equal starts go in the order of the
rules; repeated rows are scanned each; a null id is kept; an empty table gives no rows; other columns
are not used, whatever their names, and `redact` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton
from .common import pieces, text_bytes

PART = 1 << 21  # bytes of a batch that are scanned at once
FEW = 32  # lanes below which plain Python is faster than numpy


def _assigned(found: bytes) -> bool:
    """Whether the value after the first : or = has six characters or more."""
    value = found[min(i for i in (found.find(b":"), found.find(b"=")) if i >= 0) + 1 :].lstrip(b" ")
    return len(value) - (value[:1] in (b'"', b"'")) >= 6


def _at_least(*sizes: int) -> Callable[[bytes], bool]:
    """Whether the parts between dots have at least these sizes."""
    return lambda found: all(len(part) >= n for part, n in zip(found.split(b"."), sizes, strict=True))


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `pattern` delimits the spans; `keep` drops some."""

    kind: str
    pattern: str
    fold: bool = False
    keep: Callable[[bytes], bool] | None = None


#: The three base kinds in their order, then further kinds of published token formats.
_KEY = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
RULES = (
    Rule("assign", _KEY + "[A-Za-z0-9+/_.=-]+", True, _assigned),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
    Rule("github", "gh[opsur]_[A-Za-z0-9]+", keep=_at_least(40)),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", keep=_at_least(15)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", keep=_at_least(11, 11, 8)),
    Rule("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")


class Scanner:
    """The automata of a set of rules; arrays only, so it travels to the executors as it is."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        expressions = [(r.pattern, r.fold) for r in rules]
        search = Automaton(expressions, True, backward=True)
        # states are numbered so that those in which a match starts come last
        order = np.argsort(search.accepts > 0, kind="stable")
        rank = np.argsort(order)
        table = rank[search.table[order]].astype(np.int32)
        self.classes, self.start, self.accepts = search.classes, int(rank[search.start]), search.accepts[order]
        self.first_hit = int((self.accepts == 0).sum())
        self.width = table.shape[1]
        self.flat = table.reshape(-1) * np.int32(self.width)  # states are row offsets
        self.rows = table.tolist()
        self.least = search.shortest()
        self.cuts = (table == self.start).all(0)[self.classes]
        ends = Automaton(expressions, False)
        self.end_classes, self.end_rows, self.end_start = ends.classes.tobytes(), ends.table.tolist(), ends.start
        self.end_accepts, self.end_alive = ends.accepts.tolist(), ends.alive.tolist()

    def starts(self, b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where matches start in a block, by place: the places, the rules (as bits), and the ends of their stretches."""
        cut = self.cuts[b]
        edge = np.zeros(len(b) + 1, bool)
        edge[offs] = True
        begin, end = ~cut, ~cut
        begin[1:] &= cut[:-1] | edge[1:-1]
        end[:-1] &= cut[1:] | edge[1:-1]
        lo, hi = np.flatnonzero(begin), np.flatnonzero(end) + 1
        long = hi - lo >= self.least
        lo, hi = lo[long], hi[long]
        order = np.argsort(lo - hi, kind="stable")
        lo, hi = lo[order], hi[order]
        size = hi - lo
        code = self.classes[b]
        state = np.full(len(lo), self.start * self.width, np.int32)
        active = len(lo) - np.searchsorted(size[::-1], np.arange(1, (size[0] if len(size) else 0) + 1), "left")
        places, rules, until = [], [], []
        step, hit = 0, self.first_hit * self.width
        for n in active.tolist():
            if n <= FEW:
                break
            step += 1
            now = self.flat[state[:n] + code[hi[:n] - step]]
            state[:n] = now
            if step >= self.least and len(found := np.flatnonzero(now >= hit)):
                places.append(hi[found] - step)
                rules.append(self.accepts[now[found] // self.width])
                until.append(hi[found])
        for k in range(int(active[step]) if step < len(active) else 0):
            s, rows, first, own, top = int(state[k]) // self.width, self.rows, self.first_hit, [], int(hi[k]) - step
            found = []
            for at, c in enumerate(code[lo[k] : top][::-1].tobytes(), 1):
                s = rows[s][c]
                if s >= first:
                    own.append(at)
                    found.append(s)
            places.append(top - np.array(own, np.int64))
            rules.append(self.accepts[np.array(found, np.int64)])
            until.append(np.full(len(own), hi[k]))
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, rules, until = (np.concatenate(x) for x in (places, rules, until))
        order = np.argsort(places)
        return places[order], rules[order], until[order]

    def end_of(self, found: bytes, rule: int) -> tuple[int, bool]:
        """The length of the longest match of a rule at the start of some bytes, and whether it may go on after them."""
        s, end, rows, bit = self.end_start, 0, self.end_rows, 1 << rule
        for j, c in enumerate(found.translate(self.end_classes), 1):
            s = rows[s][c]
            if not self.end_alive[s] & bit:
                return end, False
            if self.end_accepts[s] & bit:
                end = j
        return end, True

    def spans(self, b: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all kept spans of a block, in bytes."""
        places, rules, until = self.starts(b, offs)
        out = []
        for k, rule in enumerate(self.rules):
            own = np.flatnonzero(rules >> k & 1)
            at, stop = places[own], until[own]
            i = 0
            while i < len(at):
                lo, hi, size, on = int(at[i]), int(stop[i]), 256, True
                while on:  # read as much as the match needs
                    end, on = self.end_of(b[lo : min(hi, lo + size)].tobytes(), k)
                    on &= lo + size < hi
                    size *= 4
                found = b[lo : lo + end].tobytes()
                if rule.keep is None or rule.keep(found):
                    out.append((lo, k, lo + end))
                i += int(np.searchsorted(at[i:], lo + end))
        return out

    def parts(self, buf: np.ndarray) -> Iterator[tuple[int, int]]:
        """Parts of about PART bytes that end after a byte at which no rule goes on."""
        lo = 0
        while lo < len(buf):
            to = min(len(buf), lo + PART)
            while to < len(buf) and not len(gap := np.flatnonzero(self.cuts[buf[to : to + PART]])):
                to = min(len(buf), to + PART)
            if to < len(buf):
                to += int(gap[0]) + 1
            yield lo, to
            lo = to

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each row with spans: (start, rule, end) in code points, by start, then rule."""
        rows: dict[int, list] = {}
        for at, to in self.parts(buf):
            i, j = np.searchsorted(offs, (at, to), "right")
            found = self.spans(buf[at:to], np.concatenate([[0], offs[i:j] - at, [to - at]]))
            row = np.searchsorted(offs, [a + at for a, _, _ in found], "right") - 1
            for r, (a, k, b) in zip(row.tolist(), found, strict=True):
                rows.setdefault(r, []).append((at + a, k, at + b))
        for r, spans in rows.items():
            base = int(offs[r])
            places = np.unique([base, *(p for a, _, b in spans for p in (a, b))])
            first = (buf[base : int(places[-1])] & 0xC0) != 0x80  # bytes that begin a character
            points = dict(zip(places.tolist(), np.concatenate([[0], np.cumsum(np.add.reduceat(first, places[:-1] - base, dtype=np.int64))]).tolist(), strict=True))
            rows[r] = sorted((points[a], k, points[b]) for a, k, b in spans)
        return rows


@lru_cache(4)
def scanner_of(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def _scanned(batch: pa.RecordBatch, column: int, scanner: Scanner) -> Iterator[tuple[pa.RecordBatch, dict]]:
    texts = batch.column(column)
    buf, offs = text_bytes(texts.fill_null("") if texts.null_count else texts)
    for i, j in pieces(offs):
        yield batch.slice(i, j - i), scanner.scan(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key and spans array<struct<kind, start, end>> of each text, by start, then kind in the order of the rules."""
    scanner = scanner_of(rules)
    kind = docs.schema[key].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            for part, rows in _scanned(batch, 1, scanner):
                spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in rows.get(r, ())] for r in range(len(part))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(item))], ["key", "spans"])

    source = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return source.mapInArrow(run, f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("key", key)


def redact(docs: DataFrame, text: str = "text", chars: str | None = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with each span (overlapping ones as one) replaced by its first kind in angle brackets; `chars`, if there is such a column, counts the code points of changed texts anew."""
    scanner = scanner_of(rules)
    names = docs.columns
    at = names.index(text)

    def run(batches):
        for batch in batches:
            for part, rows in _scanned(batch, at, scanner):
                if rows:
                    texts = part.column(at).to_pylist()
                    counts = part.column(names.index(chars)).to_pylist() if chars in names else None
                    for r, spans in rows.items():
                        out, to = [], 0
                        for a, k, b in spans:
                            if a >= to:
                                out += [texts[r][to:a], f"<{rules[k].kind}>"]
                            to = max(to, b)
                        texts[r] = "".join([*out, texts[r][to:]])
                        if counts is not None:
                            counts[r] = len(texts[r])
                    cols = list(part.columns)
                    cols[at] = pa.array(texts, cols[at].type)
                    if counts is not None:
                        cols[names.index(chars)] = pa.array(counts, cols[names.index(chars)].type)
                    part = pa.RecordBatch.from_arrays(cols, schema=part.schema)
                yield part

    return docs.mapInArrow(run, docs.schema)
