"""Packing documents into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcode as tc

#: Words that a window holds.
CAPACITY = 2048
#: Mean documents of a shard; each shard is partitioned by itself.
SHARD_DOCS = 2048
#: Tasks that shards are spread over at most.
MAX_TASKS = 20_000

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_counts(column: pa.Array) -> np.ndarray:
    """Words, parted by ASCII white space, of every text; 0 for null."""
    out = []
    for a, b in tc.slices(column):
        part = pc.fill_null(column.slice(a, b - a), "")
        offsets = np.concatenate([[0], np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False))]).astype(np.int64)
        data = np.frombuffer("".join(part.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)
        word = ~_IS_SPACE[data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        first = offsets[:-1][offsets[:-1] < len(data)]
        begin[first] = word[first]
        total = np.concatenate([[0], np.cumsum(begin)])
        out.append(total[offsets[1:]] - total[offsets[:-1]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k-1, of every size, by multiway differencing.

    Every size starts as a partial partition of its own.  The two partial
    partitions of the largest imbalances are merged again and again, the fullest
    part of one with the emptiest of the other, until one is left.  Ties are
    broken by position.
    """
    n = len(sizes)
    if k >= n:
        return np.arange(n)
    if k == 1:
        return np.zeros(n, np.int64)
    left, right = np.full(2 * n, -1, np.int64), np.full(2 * n, -1, np.int64)
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of merged partitions: descending sums and their trees
    extra_left: list[int] = []
    extra_right: list[int] = []
    serial = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        parts = []
        for x in (a, b):
            if x in sums:
                parts.append(sums.pop(x))
            else:
                s, t = np.zeros(k, np.int64), np.full(k, -1, np.int64)
                s[0], t[0] = sizes[x], x
                parts.append((s, t))
        (sa, ta), (sb, tb) = parts
        s, tb = sa + sb[::-1], tb[::-1]
        t = np.where(ta < 0, tb, ta)
        for i in np.flatnonzero((ta >= 0) & (tb >= 0)).tolist():
            extra_left.append(int(ta[i]))
            extra_right.append(int(tb[i]))
            t[i] = n + len(extra_left) - 1
        order = np.argsort(-s, kind="stable")
        s, t = s[order], t[order]
        s = s - s[-1]
        sums[serial] = (s, t)
        heapq.heappush(heap, (-int(s[0]), serial))
        serial += 1
    out = np.zeros(n, np.int64)
    (trees,) = [t for _, t in sums.values()]
    for window, tree in enumerate(trees.tolist()):
        stack = [tree] if tree >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = window
            else:
                stack += [extra_left[x - n], extra_right[x - n]]
    return out


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Windows of sizes that each fit: as few as the total needs, and more while any is over its capacity."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity)) if len(sizes) else 0
    while k:
        own = differencing(sizes, k)
        full = np.bincount(own, sizes, minlength=k)
        over = int(np.maximum(full - capacity, 0).sum())
        if not over:
            return own, k
        k += max(1, over // capacity)
    return np.zeros(0, np.int64), 0


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(window_id, doc_id, start_word, end_word, n_words): the pieces of every window.

    Documents of more than ``capacity`` words are cut into full windows and a rest;
    rests and shorter documents are spread over windows of nearly equal fill.  Only
    ids and word counts are shuffled, into shards of about ``shard_docs`` documents
    whose number grows with the table.  Documents without words (null, empty, blank)
    are in no window; repeated rows are packed as often as they occur; other
    columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(2).to_numpy()
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
            again = np.empty(len(key), np.int64)  # how many rows before it in the batch are equal
            again[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
            mixed = tc.mix(key.view(np.uint64) + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(word_counts(batch.column(1))), pa.array(mixed)], ["doc_id", "n", "mixed"])

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n"], kind="stable", na_position="last")
        ids, n, shard = pdf["doc_id"].array, pdf["n"].to_numpy(), int(pdf["shard"].iloc[0])
        fulls = n // capacity
        rest = n - fulls * capacity
        at = np.flatnonzero(rest)
        own, k = windows(rest[at], capacity)
        whole = np.repeat(np.arange(len(n)), fulls)
        start = (np.arange(len(whole)) - np.repeat(np.cumsum(fulls) - fulls, fulls)) * capacity
        row = np.concatenate([at, whole])
        begin = np.concatenate([fulls[at] * capacity, start])
        size = np.concatenate([rest[at], np.full(len(whole), capacity)])
        window = np.concatenate([own, k + np.arange(len(whole))])
        return pd.DataFrame({"window_id": (shard << 32) + window, "doc_id": ids.take(row), "start_word": begin, "end_word": begin + size, "n_words": size})

    # by id and text, so that documents without an id spread too; rows that are equal in both, by their number
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text"))
    shards = max(1, -(-docs.count() // shard_docs))
    counted = rows.mapInArrow(count, "doc_id long, n long, mixed long").filter("n > 0")
    counted = counted.select("doc_id", "n", F.pmod("mixed", F.lit(shards)).alias("shard"))
    schema = "window_id long, doc_id long, start_word long, end_word long, n_words long"
    # an explicit number of partitions: a shard costs far more time than its few bytes suggest
    return counted.repartition(min(shards, MAX_TASKS), "shard").groupBy("shard").applyInPandas(spread, schema)
