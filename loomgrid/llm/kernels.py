"""Text kernels: word hashes and shingle hashes over batches of UTF-8 bytes.

A word is known by 64 bits. Words of up to SHORT bytes are read as numbers and hashed by two keyed sums of
products of their halves modulo 2**64, of which the upper 32 bits are kept (pair-wise independent
multiply-shift hashing); longer words by a keyed BLAKE2b. Two given words share a hash with a chance of
2**-64, whatever their bytes.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

PART = 1 << 19  # bytes split into words at once; longer texts are cut at white space
SHORT = 16
U64 = np.uint64
_KEY = b"word hashes of near-duplicate search"
_rng = np.random.default_rng(20240607)
_PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U64(1)
_TIMES = np.frombuffer(blake2b(_KEY, digest_size=64).digest() + blake2b(_KEY[::-1], digest_size=32).digest(), U64).reshape(2, 6)
_LOW, _HIGH = U64(0xFFFFFFFF), U64(0xFFFFFFFF00000000)
#: Bits of the first n bytes of eight.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: A-Z to a-z, as a table and for bytes.translate.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_FOLD = np.frombuffer(FOLD, np.uint8)
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit values (xor-shifts and odd multiplications)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _short(b: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of words of up to SHORT bytes at some places."""
    padded = np.concatenate([b, np.zeros(SHORT, np.uint8)])
    eight = np.ndarray(len(b) + 8, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    first = eight[start] & _MASK[np.minimum(size, 8)]
    second = eight[np.minimum(start + 8, len(b) + 7)] & _MASK[np.clip(size - 8, 0, 8)]
    parts = (first & _LOW, first >> U64(32), second & _LOW, second >> U64(32), size.astype(U64))
    one, two = (np.add.reduce([x * k for x, k in zip(parts, keys, strict=False)]) + keys[5] for keys in _TIMES)
    return (one >> U64(32)) | (two & _HIGH)


def _block(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block, and the number of words before each row."""
    if not len(b):
        return np.zeros(0, U64), np.zeros(len(offs), np.int64)
    b = _FOLD[b]
    ws = _WS[b]
    start, end = ~ws, ~ws
    edge = np.zeros(len(b) + 1, bool)
    edge[offs] = True
    start[1:] &= ws[:-1] | edge[1:-1]
    end[:-1] &= ws[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    out = _short(b, start, end - start)
    for i in np.flatnonzero(end - start > SHORT):
        out[i] = int.from_bytes(blake2b(b[start[i] : end[i]], digest_size=8, key=_KEY).digest(), "little")
    return out, np.searchsorted(start, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without white space, A-Z as a-z) of the rows, and the words before each row."""
    found, first, i, n, base = [], [np.zeros(1, np.int64)], 0, len(offs) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + PART, "right")) - 1))
        lo, hi = int(offs[i]), int(offs[j])
        if j > i + 1 or hi - lo <= PART:
            own, before = _block(buf[lo:hi], offs[i : j + 1] - lo)
            found.append(own)
            first.append(before[1:] + base)
            base += len(own)
        else:
            while lo < hi:
                to = min(hi, lo + PART)
                while to < hi and not _WS[buf[to]]:
                    gap = np.flatnonzero(_WS[buf[to : min(hi, to + PART)]])
                    to = to + int(gap[0]) if len(gap) else min(hi, to + PART)
                found.append(_block(buf[lo:to], np.array([0, to - lo]))[0])
                base += len(found[-1])
                lo = to
            first.append(np.array([base]))
        i = j
    return np.concatenate(found) if found else np.zeros(0, U64), np.concatenate(first)


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of `width` words of each row (fewer words: the whole sequence is one), and the shingles before each row."""
    count = np.diff(first)
    short = (count > 0) & (count < width)
    number = np.where(count >= width, count - width + 1, short.astype(np.int64))
    at = np.concatenate([[0], np.cumsum(number)])
    out = np.empty(at[-1], U64)
    if len(words) >= width:
        n = len(words) - width + 1
        s = words[:n] * _PLACE[0]
        for k in range(1, width):
            s += words[k : n + k] * _PLACE[k]
        whole = np.repeat(first[1:], count)[:n] >= np.arange(width, n + width)
        mine = np.ones(len(out), bool)
        mine[at[:-1][short]] = False
        out[mine] = mix(s[whole])
    for d in np.flatnonzero(short):
        w = words[first[d] : first[d + 1]]
        out[at[d] : at[d + 1]] = mix(np.add.reduce(w * _PLACE[: len(w)], keepdims=True) + _PLACE[63 - len(w) : 64 - len(w)])
    return out, at


def distinct(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each row."""
    return [np.unique(values[at[d] : at[d + 1]]) for d in range(len(at) - 1)]


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    return distinct(*shingle_hashes(*word_hashes(buf, offs), width))
