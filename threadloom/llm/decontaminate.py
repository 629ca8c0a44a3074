"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcode as tc

#: Least words of a tile; items of fewer words must occur as a whole.
MIN_MATCH = 5
#: Share of an item's words that the tiles must cover for a document to count as contaminated.
MIN_COVERAGE = 0.5
#: Benchmark words that are broadcast at a time; a larger benchmark is worked through in slices.
SLICE_WORDS = 2_000_000

_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


class _Rolling:
    """Karp-Rabin hashes of all windows of any length, from prefix sums modulo 2**64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        steps = np.full(max(n, 1), _BASE, np.uint64)
        steps[0] = 1
        back = np.full(max(n, 1), _BASE_INV, np.uint64)
        back[0] = 1
        self.inverse = np.multiply.accumulate(back)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * np.multiply.accumulate(steps)[:n], out=self.total[1:])
        self.n = n

    def windows(self, size: int) -> np.ndarray:
        if self.n < size:
            return np.zeros(0, np.uint64)
        return (self.total[size:] - self.total[:-size]) * self.inverse[: self.n - size + 1]


def tiles(pattern: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (pattern start, text start, length) of the marked matches.

    Longest matches are marked first; a word is part of at most one tile.  The
    search length starts high, is halved down to ``min_match``, and jumps up when a
    much longer match is met, as in running Karp-Rabin matching.  Among matches of
    one length the first in the pattern, then in the text, is marked first.
    """
    m, n = len(pattern), len(text)
    if not m or not n or min(m, n) < min_match:
        return []
    p_hash, t_hash = _Rolling(pattern), _Rolling(text)
    p_free, t_free = np.ones(m, bool), np.ones(n, bool)
    out: list[tuple[int, int, int]] = []
    size = max(min_match, min(m, n, 20))
    while True:
        p_run, t_run = _free_run(p_free), _free_run(t_free)
        at_t: dict[int, list[int]] = {}
        for j in np.flatnonzero(t_run[: n - size + 1] >= size).tolist():
            at_t.setdefault(j, [])
        table: dict[int, list[int]] = {}
        windows_t = t_hash.windows(size)
        for j in at_t:
            table.setdefault(int(windows_t[j]), []).append(j)
        found: list[tuple[int, int, int]] = []
        longest = 0
        windows_p = p_hash.windows(size)
        for i in np.flatnonzero(p_run[: m - size + 1] >= size).tolist():
            for j in table.get(int(windows_p[i]), ()):
                reach = min(int(p_run[i]), int(t_run[j]))
                same = pattern[i : i + reach] == text[j : j + reach]
                length = reach if same.all() else int(same.argmin())
                if length >= size:
                    longest = max(longest, length)
                    found.append((length, i, j))
        if longest > 2 * size:
            size = longest
            continue
        found.sort(key=lambda f: (-f[0], f[1], f[2]))
        queue = found
        while queue:
            rest = []
            for length, i, j in queue:
                free = p_free[i : i + length] & t_free[j : j + length]
                if free.all():
                    p_free[i : i + length] = t_free[j : j + length] = False
                    out.append((i, j, length))
                else:
                    left = int(free.argmin())
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
                    rest += [(int(b - a), i + int(a), j + int(a)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= size and (a or left)]
            rest.sort(key=lambda f: (-f[0], f[1], f[2]))
            queue = rest
        if size > 2 * min_match:
            size //= 2
        elif size > min_match:
            size = min_match
        else:
            return out


def _free_run(free: np.ndarray) -> np.ndarray:
    """Length of the unmarked run that starts at each place."""
    n = len(free)
    at = np.arange(n)
    stops = np.where(free, n, at)
    return np.minimum.accumulate(stops[::-1])[::-1] - at


@dataclass(frozen=True)
class Benchmark:
    """Words of the items of one slice and their seeds, by seed length."""

    item_ids: np.ndarray
    words: np.ndarray
    off: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]


def load(benchmark: DataFrame, min_match: int = MIN_MATCH, slice_words: int = SLICE_WORDS) -> list[Benchmark]:
    """The benchmark in slices of at most ``slice_words`` words (or one item).

    Items without an id or without words are left out; repeated items count once.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    # the rows are drawn partition by partition, so the driver holds one slice at a time beside what is already coded
    out: list[Benchmark] = []
    ids: list[int] = []
    texts: list[str] = []
    count = 0
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"].split()) + 1
        if texts and count + n > slice_words:
            out.append(_coded(ids, texts, min_match))
            ids, texts, count = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        count += n
    if texts:
        out.append(_coded(ids, texts, min_match))
    return out


def _coded(ids: list[int], texts: list[str], min_match: int) -> Benchmark:
    w = tc.Words(pa.array(texts, pa.string()))
    sizes = np.diff(w.off)
    seeds = {}
    for n in sorted({int(min(min_match, s)) for s in sizes if s > 0}):
        own = np.flatnonzero(np.minimum(sizes, min_match) == n)
        grams, off = tc.ngrams(w.hash, w.off, n)
        pick = np.concatenate([np.arange(off[i], off[i + 1]) for i in own])
        items = np.repeat(own, np.diff(off)[own])
        order = np.lexsort((items, grams[pick]))
        pairs = np.unique(np.stack([grams[pick][order], items[order].astype(np.uint64)], 1), axis=0)
        seeds[n] = (pairs[:, 0].copy(), pairs[:, 1].astype(np.int64))
    return Benchmark(np.array(ids, np.int64), w.hash, w.off, seeds)


def _scan(column: pa.Array, bench: Benchmark, min_match: int, min_coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, coverage, number of tiles, longest tile) of the contaminated rows."""
    for a, b in tc.slices(column):
        w = tc.Words(column.slice(a, b - a))
        for n, (seed, owner) in bench.seeds.items():
            grams, off = tc.ngrams(w.hash, w.off, n)
            low = np.searchsorted(seed, grams, side="left")
            at = np.flatnonzero(seed[np.minimum(low, len(seed) - 1)] == grams)
            if not len(at):
                continue
            low, high = low[at], np.searchsorted(seed, grams[at], side="right")
            rows = np.searchsorted(off, at, side="right") - 1
            many = high - low
            item = owner[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            place = np.repeat(at - off[rows], many)
            key = np.repeat(rows, many) * len(bench.item_ids) + item
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            edges = np.flatnonzero(np.diff(key, prepend=-1))
            for s, e in zip(edges, [*edges[1:], len(key)]):
                row, it = divmod(int(key[s]), len(bench.item_ids))
                pattern = bench.words[bench.off[it] : bench.off[it + 1]]
                if min(len(pattern), (e - s) * n) < min_coverage * len(pattern):
                    continue  # so few seeds can't cover enough
                text = w.hash[w.off[row] : w.off[row + 1]]
                # every tile consists of seeds: other words can't be part of one
                near = np.zeros(len(text) + 1, np.int64)
                np.add.at(near, place[s:e], 1)
                np.add.at(near, np.minimum(place[s:e] + n, len(text)), -1)
                inside = np.cumsum(near)[:-1] > 0
                parts = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
                joined: list[np.ndarray] = []
                for x, y in zip(parts[::2], parts[1::2]):
                    joined += [text[x:y], np.zeros(1, np.uint64)]  # 0 parts the runs
                marked = tiles(pattern, np.concatenate(joined), min(min_match, len(pattern)))
                covered = sum(t[2] for t in marked)
                if covered and covered >= min_coverage * len(pattern):
                    yield a + row, it, covered / len(pattern), len(marked), max(t[2] for t in marked)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest_tile) of every contaminated pair.

    A document is scanned once per slice of the benchmark, without a shuffle: seeds
    of ``min_match`` words that it shares with an item lead to the tiling of that
    pair.  Null or empty texts match nothing; repeated rows are reported again;
    other columns are ignored; an empty benchmark gives no rows.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, coverage double, n_tiles int, longest_tile int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL")
    out = None
    for part in load(benchmark, min_match, slice_words):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(_scan(batch.column(1), shared.value, min_match, min_coverage))
                if found:
                    row, item, cover, n, longest = map(list, zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array(shared.value.item_ids[item]), pa.array(cover), pa.array(n, pa.int32()), pa.array(longest, pa.int32())],
                        ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"],
                    )

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``docs`` without contaminated rows; rows with a null text stay.  A map, without a shuffle."""
    for part in load(benchmark, min_match, slice_words):
        docs = docs.filter(~_leaks(docs.sparkSession.sparkContext.broadcast(part), min_match, min_coverage)("text"))
    return docs


def _leaks(shared, min_match: int, min_coverage: float):
    @F.arrow_udf("boolean")
    def leaks(texts: pa.Array) -> pa.Array:
        hit = np.zeros(len(texts), bool)
        for row, *_ in _scan(texts, shared.value, min_match, min_coverage):
            hit[row] = True
        return pa.array(hit)

    return leaks
