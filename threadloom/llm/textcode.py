"""Vectorised word coding shared by the operators of this subpackage.

A *word* is a maximal run of ASCII letters and digits and of any non-ASCII
characters, after Unicode lower-casing; everything else separates words.  Words
and word n-grams are represented by 64-bit hashes that are computed for a whole
Arrow string array at once: a polynomial prefix sum over the bytes gives every
word's hash by one subtraction, so the cost is a few nanoseconds a byte and no
Python object is made per word.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are coded at a time, which take some 50 times as much memory; longer single texts are coded alone.
CHUNK_BYTES = 1 << 19

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True

#: The same words as a regular expression, for SQL and for slow reference code.
WORD_PATTERN = r"[a-z0-9\x{80}-\x{10FFFF}]+"
WORD_PATTERN_PY = r"[a-z0-9\x80-\U0010ffff]+"

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK_BYTES, 1 << max(1, n).bit_length())
    if size not in _powers:
        out = []
        for base in (_B, _B_INV):
            p = np.full(size + 1, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size == CHUNK_BYTES:
            _powers[size] = (out[0], out[1])
        return out[0], out[1]
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: spreads 64-bit values evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start, n = 0, len(column)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


class Words:
    """Word hashes of the rows of a string array; ``off[i]:off[i + 1]`` are row i's."""

    __slots__ = ("hash", "off", "start", "end", "byte_off", "data", "_total", "_inverse")

    def __init__(self, column: pa.Array):
        lowered = pc.utf8_lower(pc.fill_null(column, ""))
        if isinstance(lowered, pa.ChunkedArray):
            lowered = lowered.combine_chunks()
        wide = np.int64 if pa.types.is_large_string(lowered.type) else np.int32
        n = len(lowered)
        offsets = np.frombuffer(lowered.buffers()[1], dtype=wide)[lowered.offset : lowered.offset + n + 1].astype(np.int64)
        raw = lowered.buffers()[2]
        first = int(offsets[0]) if n else 0
        size = int(offsets[-1]) - first if n else 0
        data = np.frombuffer(raw, dtype=np.uint8, count=size, offset=first) if size else np.zeros(0, np.uint8)
        offsets = offsets - first
        inside = _IS_WORD[data]
        before = np.empty(size + 1, dtype=bool)
        before[0] = False
        before[1:] = inside
        begin = inside & ~before[:-1]
        inner = offsets[(offsets > 0) & (offsets < size)]
        begin[inner] |= inside[inner]
        after = np.empty(size, dtype=bool)
        if size:
            after[:-1] = inside[:-1] & (~inside[1:] | begin[1:])
            after[-1] = inside[-1]
        self.data = data
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(after) + 1
        power, inverse = _pow(size)
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:size], out=total[1:])
        value = (total[self.end] - total[self.start]) * inverse[self.start]
        self.hash = mix(value + (self.end - self.start).astype(np.uint64))
        self._total, self._inverse = total, inverse
        self.byte_off = offsets
        self.off = np.searchsorted(self.start, offsets, side="left")

    def __len__(self) -> int:
        return len(self.off) - 1

    def prefix(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the first ``n`` bytes of the given words, which must have as many."""
        s = self.start[at]
        value = (self._total[s + n] - self._total[s]) * self._inverse[s]
        return mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5 + n))

    def text(self, i: int) -> str:
        """The i-th word."""
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def ngrams(words: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of every row and their row offsets.

    A row of 1 to n-1 words has one gram, of all its words; a row without words none.
    """
    sizes = np.diff(off)
    counts = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    out_off = np.zeros(len(off), dtype=np.int64)
    np.cumsum(counts, out=out_off[1:])
    if not len(words):
        return np.zeros(0, np.uint64), out_off
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    acc = np.full(len(words), np.uint64(n))
    for k in range(n):
        acc = mix(acc * _B + padded[k : k + len(words)])
    rows = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(out_off[-1]) - out_off[rows] + off[:-1][rows]
    grams = acc[at]
    for i in np.flatnonzero((sizes > 0) & (sizes < n)):
        h = np.uint64(sizes[i])
        for w in words[off[i] : off[i + 1]]:
            h = mix(np.array([h], np.uint64) * _B + w)[0]
        grams[out_off[i]] = h
    return grams, out_off


def distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row's values, ascending and without repeats."""
    n = len(off) - 1
    rows = np.repeat(np.arange(n), np.diff(off))
    if len(values) >= 32 * n:  # long rows are sorted one by one, which is the fastest
        v, r = values.copy(), rows
        for s, e in zip(off[:-1].tolist(), off[1:].tolist()):
            v[s:e].sort()
    else:
        order = np.argsort(values)
        order = order[np.argsort(rows[order].astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")]
        v, r = values[order], rows[order]
    keep = np.ones(len(v), dtype=bool)
    if len(v):
        keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[keep], r[keep]
    out = np.zeros(len(off), dtype=np.int64)
    np.cumsum(np.bincount(r, minlength=n), out=out[1:])
    return v, out
