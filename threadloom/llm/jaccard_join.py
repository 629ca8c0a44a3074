"""N-gram Jaccard self-join with prefix trees.

The word n-grams of a text, as 64-bit hashes, are its set; a link is a pair of
texts whose sets reach the threshold.  Texts of equal sets are one class.  The
join is exact over whole sets:

1. *Counting.*  A text can only have a link if a share ``threshold`` of its grams
   is in other texts too.  Every gram is sent, as a short code with its document,
   to the bucket of its code, where codes of several documents are found, and the
   number of these comes back to each document.  Codes that coincide only make
   the number larger, so nothing is lost; documents that fall short leave.
2. *Items.*  The whole grams of one document of each remaining class go to
   buckets again.  Grams that exactly the same classes hold act alike, so they
   become one item that weighs as much as their number.  Items are put in a
   global order, those of most classes first.
3. *Components.*  Two sets that reach the threshold share EVIDENCE grams (or as
   many as small sets must share) among the rarest ``n - threshold * n + EVIDENCE``
   grams of each, in items that are their places, and their sizes are near.
   Classes of near size that share so many grams in places, or a place of more
   than FEW classes, whose pairs aren't listed, are connected; what isn't
   connected has no link.  One rare phrase in common, which grows likely
   in a large corpus, connects nothing.
4. *Prefix trees.*  The sets of a component, in the global order, form a trie,
   whose common paths all sets share.  All of them traverse it together, a level
   at a time, carrying the overlap so far; a subtree is left as soon as its
   remaining length can't lift the overlap to what the threshold asks for, or
   its set sizes exclude it.  A component of more than BLOCK_ITEMS items is cut
   into blocks of like size, and the pairs of blocks that hold connected classes
   are joined.

Grams that are in a large share of a sample of documents (boilerplate) aren't
sent in step 1 and 2 but known to all tasks; this decides who counts them, never
the result.  Nothing is capped or sampled, and what comes out grows with the
number of documents, not of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.community import stars
from . import shared
from . import textcode as tc

#: Words of a gram; least Jaccard similarity of a link.
N, THRESHOLD = 3, 0.5

#: Grams that a task holds at once: of a bucket, and of those to be sent.
BUCKET_GRAMS, FLUSH_GRAMS = 2 << 20, 1 << 20
#: Bits of a code beyond those that number all grams.
SPARE_BITS = 7
#: A gram in one of HOT_SHARE documents, by a sample of HOT_SAMPLE, is known to all tasks.  There are at most
#: HOT_SHARE times as many as a document has grams on average, whatever the number of documents.
HOT_SAMPLE, HOT_SHARE = 4096, 64
#: Levels of size that two sets at the threshold may be apart.
LEVELS = 5
#: Grams in places that connect two classes, and classes of a place up to which its pairs are listed.
EVIDENCE, FEW = 4, 256
#: Items of a trie beyond which a component is joined in blocks.
BLOCK_ITEMS = 1 << 17
#: Entries of a traversal's frontier, and bytes of its membership table, at once.
FRONTIER = 1 << 20

_HOT_DF = 1 << 30


# -- columns of numbers as bytes -------------------------------------------------------------------------


def _pack(*columns: np.ndarray) -> bytes:
    """Unsigned columns as compressed byte planes; ascending ones are best given as differences."""
    head, parts = [len(columns)], []
    for c in columns:
        c = c.astype(np.uint64)
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        head += [len(c), width]
        parts.append(c.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 1 + 2 * count)[1:]
    at, out = 8 * (1 + 2 * count), []
    for n, width in head.reshape(-1, 2).tolist():
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(planes.view(np.uint64).ravel())
        at += n * width
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """First value and differences, modulo 2**64."""
    v = ascending.astype(np.uint64)
    return np.concatenate([v[:1], v[1:] - v[:-1]])


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


# -- sets ------------------------------------------------------------------------------------------------


def _sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct grams, row offsets, and a signature of each row's set."""
    words = tc.Words(column)
    grams, off = tc.distinct(*tc.ngrams(words.hash, words.off, n))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tc.mix(grams ^ np.uint64(0x5851F42D4C957F2D)))])
    sig = tc.mix(total[off[1:]] - total[off[:-1]] + np.diff(off).astype(np.uint64))
    return grams, off, sig.view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")


def _gathered(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc_ids, signatures, sizes, grams) of about FLUSH_GRAMS grams at a time, without texts that have no word."""
    held: list[tuple] = []
    total = 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for a, b in tc.slices(batch.column(1)):
            grams, off, sig = _sets(batch.column(1).slice(a, b - a), n)
            sizes = np.diff(off)
            has = sizes > 0
            held.append((ids[a:b][has], sig[has], sizes[has], grams))
            total += len(grams)
            if total >= FLUSH_GRAMS:
                yield tuple(map(np.concatenate, zip(*held)))
                held, total = [], 0
    if total:
        yield tuple(map(np.concatenate, zip(*held)))


def signed(texts: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, sig, n) of every text that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sig, sizes, _ in _gathered(batches, n):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sig), pa.array(sizes.astype(np.int32))], ["doc_id", "sig", "n"])

    return texts.mapInArrow(run, "doc_id long, sig long, n int")


def _hot(texts: DataFrame, n_texts: int, n: int) -> np.ndarray:
    """Grams that at least one of HOT_SHARE documents of a sample has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, grams in _gathered(batches, n):
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64))], ["gram"])

    part = min(1.0, HOT_SAMPLE / max(1, n_texts))
    few = texts if part == 1.0 else texts.sample(part, seed=7)
    often = few.mapInArrow(run, "gram long").groupBy("gram").count().filter(F.col("count") >= HOT_SAMPLE // HOT_SHARE)
    return np.sort(often.select("gram").toArrow().column(0).to_numpy().view(np.uint64))


def _among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


# -- buckets ---------------------------------------------------------------------------------------------

_SENT = "place int, kind int, data binary"
_SENT_NAMES, _SENT_TYPES = ["place", "kind", "data"], [pa.int32(), pa.int32(), pa.binary()]


def _cut(codes: np.ndarray, owner: np.ndarray, keys: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """The codes by bucket, each ascending, with the keys of their owners (index of ``keys``)."""
    order = np.argsort(codes)
    codes, owner = codes[order], owner[order]
    step = -(-(1 << bits) // buckets)
    edges = np.searchsorted(codes, np.array([min(b * step, (1 << 64) - 1) for b in range(1, buckets)], np.uint64))
    for b, (s, e) in enumerate(zip([0, *edges], [*edges, len(codes)])):
        if e > s:
            own, at = np.unique(owner[s:e], return_inverse=True)
            yield b, _pack(_steps(codes[s:e]), at, _steps(keys[own]))


def _joined(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, their owners and the keys of the owners of several packed parts, by code."""
    codes, owners, keys, base = [], [], [], 0
    for blob in blobs:
        c, at, k = _unpack(blob)
        codes.append(np.cumsum(c, dtype=np.uint64))
        owners.append(at.astype(np.int64) + base)
        keys.append(np.cumsum(k, dtype=np.uint64))
        base += len(k)
    code, owner = np.concatenate(codes), np.concatenate(owners)
    order = np.argsort(code)
    return code[order], owner[order], np.concatenate(keys)


def _by_place(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[int, list[bytes]]]:
    """The packed parts of a partition by place and kind."""
    found: dict[int, dict[int, list[bytes]]] = {}
    for batch in batches:
        for place, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found.setdefault(place, {}).setdefault(kind, []).append(data)
    return found


def _buckets(spark, bytes_of_text: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-bytes_of_text // (6 * BUCKET_GRAMS)))


def _candidates(texts: DataFrame, n: int, threshold: float, bytes_of_text: int, hot: np.ndarray) -> DataFrame:
    """(doc_id): documents of which at least ``threshold`` of the grams may be in others too."""
    spark = texts.sparkSession
    buckets = _buckets(spark, bytes_of_text)
    bits = min(64, max(32, (bytes_of_text // 4 + 1).bit_length() + SPARE_BITS))
    known = spark.sparkContext.broadcast(hot)

    def home(ids: np.ndarray) -> np.ndarray:
        return (tc.mix(ids.view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(buckets)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, sizes, grams in _gathered(batches, n):
            by_id = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[by_id] = np.arange(len(ids))
            owner = np.repeat(rank, sizes)  # documents in the order of their ids, so that these pack well
            often = _among(known.value, grams)
            everywhere = np.bincount(owner[often], minlength=len(ids))
            ids, sizes = ids[by_id], sizes[by_id]
            rows = [(b, 0, data) for b, data in _cut(grams[~often] >> np.uint64(64 - bits), owner[~often], ids.view(np.uint64), bits, buckets)]
            one, first, times = np.unique(ids, return_index=True, return_counts=True)
            place = home(one)
            for p in np.unique(place):
                k = place == p
                rows.append((int(p), 1, _pack(_steps(one[k]), sizes[first[k]], everywhere[first[k]], times[k])))
            yield _rows(rows, _SENT_NAMES, _SENT_TYPES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, kinds in _by_place(batches).items():
            rows = [(place, 1, data) for data in kinds.get(1, [])]
            if 0 in kinds:
                code, owner, keys = _joined(kinds.pop(0))
                twice = np.zeros(len(code), bool)
                twice[1:] = code[1:] == code[:-1]
                twice[:-1] |= twice[1:]
                hits = np.bincount(owner[twice], minlength=len(keys))
                ids = keys[hits > 0].view(np.int64)
                hits, to = hits[hits > 0], home(ids)
                order = np.lexsort((ids, to))
                ids, hits, to = ids[order], hits[order], to[order]
                edges = np.flatnonzero(np.diff(to, prepend=-1))
                for s, e in zip(edges, [*edges[1:], len(to)]):
                    rows.append((int(to[s]), 0, _pack(_steps(ids[s:e]), hits[s:e])))
            if rows:
                yield _rows(rows, _SENT_NAMES, _SENT_TYPES)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in _by_place(batches).values():
            told = [_unpack(d) for d in kinds[1]]
            ids, at = np.unique(np.concatenate([np.cumsum(t[0], dtype=np.uint64).view(np.int64) for t in told]), return_inverse=True)
            size, hits, times = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            size[at] = np.concatenate([t[1] for t in told])
            np.add.at(hits, at, np.concatenate([t[2] for t in told]).astype(np.int64))
            np.add.at(times, at, np.concatenate([t[3] for t in told]).astype(np.int64))
            for d in kinds.get(0, []):
                i, h = _unpack(d)
                np.add.at(hits, np.searchsorted(ids, np.cumsum(i, dtype=np.uint64).view(np.int64)), h.astype(np.int64))
            stays = (times > 1) | (hits >= threshold * size - 1e-9)  # several texts of one id can't be told apart here
            yield pa.RecordBatch.from_arrays([pa.array(ids[stays])], ["doc_id"])

    counted = texts.mapInArrow(send, _SENT).repartitionById(buckets, F.col("place")).mapInArrow(count, _SENT)
    return counted.repartitionById(buckets, F.col("place")).mapInArrow(decide, "doc_id long")


def _items(texts: DataFrame, n: int, bytes_of_text: int, hot: np.ndarray) -> DataFrame:
    """(cls, item, df, w): the shared grams of every class, those of the same classes as one item of weight w."""
    spark = texts.sparkSession
    buckets = _buckets(spark, bytes_of_text)
    known = spark.sparkContext.broadcast(hot)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sig, sizes, grams in _gathered(batches, n):
            by_sig = np.argsort(sig.view(np.uint64), kind="stable")
            rank = np.empty(len(sig), np.int64)
            rank[by_sig] = np.arange(len(sig))
            owner, keys = np.repeat(rank, sizes), sig.view(np.uint64)[by_sig]
            often = _among(known.value, grams)
            rows = [(b, 0, data) for b, data in _cut(grams[~often], owner[~often], keys, 64, buckets)]
            if often.any():
                rows += [(b, 1, data) for b, data in _cut(keys[owner[often]], np.arange(int(often.sum())), grams[often], 64, buckets)]
            yield _rows(rows, _SENT_NAMES, _SENT_TYPES)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cls", "item", "df", "w"]

        def out(cls, item, df, w):
            for s in range(0, len(cls), 200_000):
                e = s + 200_000
                arrays = [cls[s:e].view(np.int64), item[s:e].view(np.int64), df[s:e].astype(np.int32), w[s:e].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names)

        for kinds in _by_place(batches).values():
            if 0 in kinds:
                code, owner, keys = _joined(kinds.pop(0))
                twice = np.zeros(len(code), bool)
                twice[1:] = code[1:] == code[:-1]
                twice[:-1] |= twice[1:]
                code, cls = code[twice], keys[owner[twice]]
                order = np.lexsort((cls, code))
                code, cls = code[order], cls[order]
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (cls[1:] != cls[:-1])  # copies and repeated rows tell the same
                code, cls = code[new], cls[new]
                at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
                df = np.diff(np.append(at, len(code)))
                item = tc.mix(np.add.reduceat(tc.mix(cls ^ np.uint64(0x94D049BB133111EB)), at)) if len(at) else code  # the same classes, the same item
                gram_df, gram_item = np.repeat(df, df), np.repeat(item, df)
                k = gram_df > 1
                cls, gram_df, gram_item = cls[k], gram_df[k], gram_item[k]
                order = np.lexsort((gram_item, cls))
                cls, gram_df, gram_item = cls[order], gram_df[order], gram_item[order]
                if len(cls):
                    at = np.flatnonzero(np.concatenate([[True], (cls[1:] != cls[:-1]) | (gram_item[1:] != gram_item[:-1])]))
                    yield from out(cls[at], gram_item[at], gram_df[at], np.diff(np.append(at, len(cls))))
            for d in kinds.get(1, []):
                c, at, g = _unpack(d)
                cls, gram = np.cumsum(c, dtype=np.uint64), np.cumsum(g, dtype=np.uint64)[at.astype(np.int64)]
                yield from out(cls, gram, np.full(len(cls), _HOT_DF), np.ones(len(cls)))

    return texts.mapInArrow(send, _SENT).repartitionById(buckets, F.col("place")).mapInArrow(merge, "cls long, item long, df int, w int")


# -- prefix trees ----------------------------------------------------------------------------------------


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``counts``, its index that many times, and the numbers from 0 up."""
    rep = np.repeat(np.arange(len(counts)), counts)
    return rep, np.arange(len(rep)) - np.repeat(np.cumsum(counts) - counts, counts)


class Forest:
    """Tries of weighted sets, one for each group, stored level by level.

    Set i has size ``n[i]`` and the items ``off[i]:off[i + 1]`` in a global order.
    A node has an item, the largest weight that is left below it, the range of
    set sizes and the least set number of its subtree.
    """

    def __init__(self, n: np.ndarray, off: np.ndarray, items: np.ndarray, weights: np.ndarray, group: np.ndarray, stored: np.ndarray):
        self.n, self.off, self.group, self.stored = n, off, group, stored
        length = np.diff(off)
        owner = np.repeat(np.arange(len(n)), length)
        g = group[owner]
        order = np.lexsort((items, g))
        new = np.ones(len(order), bool)
        new[1:] = (items[order][1:] != items[order][:-1]) | (g[order][1:] != g[order][:-1])
        local = np.empty(len(order), np.int64)
        local[order] = np.cumsum(new) - 1
        self.width = np.bincount(g[order][new], minlength=int(group.max(initial=-1)) + 1)
        self.column = local - (np.cumsum(self.width) - self.width)[g]  # the item's number in its group
        self.weights = weights
        left = np.concatenate([[0], np.cumsum(weights)])
        left = np.repeat(left[off[1:]], length) - left[1:]  # what is left of the set after each item

        self.levels = []
        alive = np.flatnonzero(stored & (length > 0))
        node = group[alive]
        wide = int(self.column.max(initial=0)) + 1
        k = 0
        while len(alive):
            at = off[alive] + k
            key, inverse = np.unique(node * wide + self.column[at], return_inverse=True)
            size = len(key)
            first = np.empty(size, np.int64)
            first[inverse] = at
            deepest, low, high, least = np.zeros(size, np.int64), np.full(size, 1 << 60), np.zeros(size, np.int64), np.full(size, 1 << 60)
            np.maximum.at(deepest, inverse, left[at])
            np.minimum.at(low, inverse, n[alive])
            np.maximum.at(high, inverse, n[alive])
            np.minimum.at(least, inverse, alive)
            done = length[alive] == k + 1
            ended = alive[done]
            by_node = np.argsort(inverse[done], kind="stable")
            parent = key // wide
            self.levels.append(
                {
                    "parent": parent,
                    "column": self.column[first],
                    "weight": weights[first],
                    "deepest": deepest,
                    "low": low,
                    "high": high,
                    "least": least,
                    "ends": ended[by_node],
                    "end_count": np.bincount(inverse[done], minlength=size),
                }
            )
            alive, node, k = alive[~done], inverse[~done], k + 1

    def _search(self, probes: np.ndarray, threshold: float, all_pairs: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = self.n
        size = self.width[self.group[probes]]
        base = np.cumsum(size) - size
        held = np.zeros(int(size.sum()), bool)
        rep, k = _spread(np.diff(self.off)[probes])
        held[base[rep] + self.column[self.off[probes][rep] + k]] = True
        floor = threshold * n[probes] - 1e-9
        low, high = floor, n[probes] / threshold + 1e-9
        node, probe, overlap = self.group[probes], np.arange(len(probes)), np.zeros(len(probes), np.int64)
        for level in self.levels:
            if not len(node):
                return
            start = np.searchsorted(level["parent"], node)
            count = np.searchsorted(level["parent"], node, side="right") - start
            rep, k = _spread(count)
            child, probe, overlap = start[rep] + k, probe[rep], overlap[rep]
            overlap = overlap + np.where(held[base[probe] + level["column"][child]], level["weight"][child], 0)
            good = (overlap + level["deepest"][child] >= floor[probe]) & (level["low"][child] <= high[probe]) & (level["high"][child] >= low[probe])
            if not all_pairs:
                good &= level["least"][child] < probes[probe]
            node, probe, overlap = child[good], probe[good], overlap[good]
            if len(level["ends"]) and len(node):
                count = level["end_count"][node]
                rep, k = _spread(count)
                first = np.cumsum(level["end_count"]) - level["end_count"]
                a, b, both = level["ends"][first[node[rep]] + k], probes[probe[rep]], overlap[rep]
                ok = both >= threshold * (n[a] + n[b] - both) - 1e-9
                if not all_pairs:
                    ok &= a < b
                yield a[ok], b[ok], both[ok]

    def pairs(self, probes: np.ndarray, threshold: float, all_pairs: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(stored set, probe, overlap) of one group that reach the threshold.

        Unless ``all_pairs``, the probes are the stored sets, and of each pair the
        lower number comes first.
        """
        per_group = np.bincount(self.group[self.stored], minlength=len(self.width))
        cost = np.maximum(per_group[self.group[probes]], self.width[self.group[probes]] // 16) + 1
        part = np.cumsum(cost) // FRONTIER
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        for s, e in zip(edges, [*edges[1:], len(probes)]):
            yield from self._search(probes[s:e], threshold, all_pairs)


def _linked(groups: list[dict], threshold: float) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """The sets of several groups in one frame, and the pairs among them (index, index, overlap)."""
    group = np.repeat(np.arange(len(groups)), [len(g["cls"]) for g in groups])
    all_of = {c: np.concatenate([g[c] for g in groups]) for c in ("cls", "side", "n", "k", "length", "items", "weights")}
    off = np.concatenate([[0], np.cumsum(all_of["length"])])
    side = all_of["side"]
    forest = Forest(all_of["n"], off, all_of["items"], all_of["weights"], group, side < 2)
    found = [*forest.pairs(np.flatnonzero(side == 0), threshold, False), *forest.pairs(np.flatnonzero(side == 2), threshold, True)]
    if not found:
        return all_of, *(np.zeros(0, np.int64),) * 3
    return all_of, *map(np.concatenate, zip(*found))


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The sorted rows (task, side, cls, n, k, items, weights) by task, several small tasks at a time."""
    held: list[dict] = []
    current, parts, total = None, [], 0

    def closed():
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    for batch in batches:
        task = batch.column(0).to_numpy()
        lists = batch.column(5)
        edges = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])) if len(task) else []
        for s, e in zip(edges, [*edges[1:], len(task)]):
            if task[s] != current and parts:
                held.append(closed())
                total += len(held[-1]["items"])
                parts = []
                if total >= BLOCK_ITEMS // 2:
                    yield held
                    held, total = [], 0
            current = task[s]
            part = lists.slice(s, e - s)
            columns = {c: batch.column(i).slice(s, e - s).to_numpy().astype(np.int64) for c, i in (("side", 1), ("cls", 2), ("n", 3), ("k", 4))}
            columns["length"] = pa.compute.list_value_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
            columns["items"] = part.flatten().to_numpy().astype(np.int64)
            columns["weights"] = batch.column(6).slice(s, e - s).flatten().to_numpy().astype(np.int64)
            parts.append(columns)
    if parts:
        held.append(closed())
    if held:
        yield held


def _labels(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of 0..size-1 is connected to."""
    label = np.arange(size)
    while True:
        least = label.copy()
        np.minimum.at(least, label[a], label[b])
        np.minimum.at(least, label[b], label[a])
        new = least[label]
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


# -- the join --------------------------------------------------------------------------------------------


def _evidence(n, threshold: float):
    """Grams in places that a set of ``n`` grams shares with any other that reaches the threshold."""
    return np.minimum(EVIDENCE, np.ceil(threshold * n - 1e-9)).astype(np.int64)


def _ordered(rows: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(cls, n, k, items, weights, places, worth): sets in the global order; places are the items of the rarest grams, worth their weights."""
    by_class = rows.repartition("cls").groupBy("cls", "item").agg(F.max("df").alias("df"), F.sum("w").cast("int").alias("w"))
    lists = by_class.groupBy("cls").agg(F.collect_list("item").alias("item"), F.collect_list("df").alias("df"), F.collect_list("w").alias("w"))
    whole = lists.join(classes, "cls").select("cls", "n", "k", "item", "df", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cls", "n", "k", "items", "weights", "places", "worth"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                cls, n, k = (batch.column(c)[i].as_py() for c in range(3))
                item, df, w = (batch.column(c)[i].values.to_numpy() for c in range(3, 6))
                need, shared_grams = threshold * n - 1e-9, int(w.sum())
                if shared_grams < need:
                    continue
                order = np.lexsort((item, -df.astype(np.int64)))
                item, w = item[order], w[order]
                rarer = n - shared_grams + np.cumsum(w[::-1])[::-1] - w  # grams that come before an item, from the rare end
                place = rarer <= n - need + _evidence(n, threshold) - 1
                out.append((cls, n, k, item, w, item[place], w[place]))
                if len(out) >= 500:
                    yield _rows(out, names, types)
                    out = []
            if out:
                yield _rows(out, names, types)

    return whole.mapInArrow(run, "cls long, n int, k long, items array<long>, weights array<int>, places array<long>, worth array<int>")


def _near(at: DataFrame, threshold: float) -> DataFrame:
    """(a, b): classes of near size with enough grams in common places of at most FEW classes.

    ``at`` has (cls, n, place, worth, many).
    """
    few = at.filter((F.col("many") > 1) & (F.col("many") <= FEW))
    groups = few.groupBy("place").agg(F.max("worth").alias("worth"), F.array_sort(F.collect_list(F.struct("cls", "n"))).alias("m"))
    # places of nearly the same classes come together, so that their pairs are added up before they are sent
    groups = groups.select(F.col("m.cls").alias("cls"), F.col("m.n").alias("n"), "worth").repartition(F.col("cls")[0]).sortWithinPartitions(F.col("cls")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pa.compute.list_value_length(batch.column(0)).to_numpy().astype(np.int64)
            cls, n = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy().astype(np.int64)
            worth = np.repeat(batch.column(2).to_numpy().astype(np.int64), length)
            later = np.repeat(np.cumsum(length), length) - np.arange(len(cls)) - 1  # those after each in its group
            part = np.cumsum(later) // FRONTIER
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            for s, e in zip(edges, [*edges[1:], len(cls)]):
                a, k = _spread(later[s:e])
                a += s
                b = a + 1 + k
                near = np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9
                a, b = a[near], b[near]
                if not len(a):
                    continue
                order = np.lexsort((cls[b], cls[a]))
                a, b = a[order], b[order]
                at = np.flatnonzero(np.concatenate([[True], (cls[a][1:] != cls[a][:-1]) | (cls[b][1:] != cls[b][:-1])]))
                both, a, b = np.add.reduceat(worth[a], at), a[at], b[at]
                least = _evidence(np.minimum(n[a], n[b]), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cls[a], cls[b], both, least)], ["a", "b", "both", "least"])

    told = groups.mapInArrow(run, "a long, b long, both long, least long")
    enough = told.groupBy("a", "b").agg(F.sum("both").alias("both"), F.max("least").alias("least")).filter("both >= least")
    return shared.written(enough.select("a", "b"), "jaccard-near")


def _components(hubs: DataFrame, near: DataFrame) -> DataFrame:
    """(cls, root) of the classes that are near, or share a place of ``hubs`` with one whose size is near enough.

    ``hubs`` has (cls, place, level).  The classes of one place and level are linked
    to the least of them, and these from level to level over gaps of LEVELS at most.
    """
    hub = hubs.groupBy("place", "level").agg(F.min("cls").alias("hub"))
    ladder = hub.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("level", "hub"))).alias("steps"))  # levels are few, whatever the place
    steps = F.transform("steps", lambda x, i: F.struct(x["hub"].alias("b"), F.get("steps", i + 1)["hub"].alias("a"), (F.get("steps", i + 1)["level"] - x["level"]).alias("gap")))
    up = ladder.select(F.explode(steps).alias("s")).filter(F.col("s.gap") <= LEVELS).select("s.a", "s.b")
    same = hubs.join(hub, ["place", "level"]).filter("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    roots = stars(same.unionByName(up).unionByName(near).filter("a <> b")).select(F.col("a").alias("cls"), F.col("b").alias("root"))
    return shared.written(roots.unionByName(roots.select(F.col("root").alias("cls"), "root").distinct()), "jaccard-components")


def _work(sets: DataFrame, threshold: float, block_items: int) -> DataFrame:
    """(task, side, cls, n, k, items, weights): every set with those that it may be linked to.

    Side 0 is compared with itself, side 1 with side 2.
    """
    step = max(np.log(1 / threshold) / (LEVELS - 1), 0.01)  # sets that can reach the threshold are LEVELS levels apart at most
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(step))).cast("int").alias("level")
    at = sets.select("cls", "n", level, F.explode(F.arrays_zip("places", "worth")).alias("p")).select("cls", "n", "level", "p.places", "p.worth").withColumnRenamed("places", "place")
    at = at.join(at.groupBy("place").agg(F.count("*").alias("many")), "place")
    hubs = shared.written(at.filter(F.col("many") > FEW).select("cls", "place", "level", "many"), "jaccard-hubs")
    near = _near(at, threshold)
    roots = _components(hubs, near)
    placed = sets.join(roots, "cls")
    large = shared.written(placed.groupBy("root").agg(F.sum(F.size("items")).alias("all")).filter(F.col("all") > block_items).select("root"), "jaccard-large")
    columns = ["cls", "n", "k", "items", "weights"]
    small = placed.join(large, "root", "left_anti").select(F.col("root").alias("task"), F.lit(0).alias("side"), *columns)
    if not large.limit(1).count():
        return small
    # blocks hold sets of one level that share a place: that which a class shares with most others; a place of many items is cut
    inner = roots.join(large, "root")
    met = at.join(inner.select("cls"), "cls", "left_semi")
    most = met.groupBy("cls", "level").agg(F.max_by("place", F.struct("many", "place")).alias("key"))
    keyed = inner.join(most, "cls").join(sets.select("cls", F.size("items").alias("size")), "cls")
    by_key = keyed.groupBy("root", "level", "key").agg(F.sum("size").alias("key_items"))
    by_level = by_key.groupBy("root", "level").agg(F.sum("key_items").alias("level_items"))
    sized = keyed.join(by_key, ["root", "level", "key"]).join(by_level, ["root", "level"])
    light = F.struct(F.lit(None).cast("long").alias("key"), F.pmod(F.xxhash64("key"), F.ceil(F.col("level_items") / block_items)).alias("part"))
    cut = F.struct(F.col("key"), F.pmod(F.xxhash64("cls"), F.ceil(F.col("key_items") / block_items)).alias("part"))
    blocks = sized.select("cls", "level", F.xxhash64("root", "level", F.when(F.col("key_items") <= block_items, light).otherwise(cut)).alias("block"))
    blocks = shared.written(blocks, "jaccard-blocks")
    seen = hubs.select("cls", "place").join(blocks, "cls").select("place", "level", "block").distinct()
    other = seen.select("place", F.col("level").alias("other_level"), F.col("block").alias("other"))
    both = seen.join(other, "place").filter((F.col("block") <= F.col("other")) & (F.abs(F.col("level") - F.col("other_level")) <= LEVELS))
    of_a, of_b = (blocks.select(F.col("cls").alias(c), F.col("block").alias(f"block_{c}")) for c in "ab")
    listed = near.join(of_a, "a").join(of_b, "b").select(F.least("block_a", "block_b").alias("block"), F.greatest("block_a", "block_b").alias("other"))
    both = shared.written(both.select("block", "other").unionByName(listed).distinct(), "jaccard-block-pairs")
    task = F.xxhash64("block", "other").alias("task")
    one = both.select("block", task, F.when(F.col("block") == F.col("other"), 0).otherwise(1).alias("side"))
    two = both.filter("block < other").select(F.col("other").alias("block"), task, F.lit(2).alias("side"))
    sent = blocks.join(one.unionByName(two), "block").select("cls", "task", "side")
    return small.unionByName(sets.join(sent, "cls").select("task", "side", *columns))


def _prepared(docs: DataFrame, n: int, threshold: float, block_items: int) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, cls) of the classes that may have links or copies, and the work (see ``_work``)."""
    spark = docs.sparkSession
    texts = _texts(docs)
    count, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    hot = _hot(texts, count, n) if count else np.zeros(0, np.uint64)
    ids = shared.written(_candidates(texts, n, threshold, size, hot), "jaccard-documents")
    some = shared.only_ids(texts, ids, ids.count())
    members = shared.written(signed(some, n).withColumnRenamed("sig", "cls").distinct(), "jaccard-members")
    classes = shared.written(members.groupBy("cls").agg(F.max("n").alias("n"), F.count("*").alias("k"), F.min("doc_id").alias("doc_id")), "jaccard-classes")
    first = shared.only_ids(texts, classes.select("doc_id"), classes.count())
    part = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = _items(first, n, 6 * part, hot)
    sets = shared.written(_ordered(rows, classes.select("cls", "n", "k"), threshold), "jaccard-sets")
    work = _work(sets, threshold, block_items)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return members.select("doc_id", "cls"), work.repartition(parts, "task").sortWithinPartitions("task", "side", "cls")


def class_links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, cls), and (cls, root, links, closest) of every class that is linked to another.

    ``links`` counts the documents of other classes, ``closest`` is the largest
    similarity to one; ``root`` is a class that it is connected to.
    """
    members, work = _prepared(docs, n, threshold, block_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _tasks(batches):
            sets, a, b, both = _linked(groups, threshold)
            size = len(sets["cls"])
            links, closest = np.zeros(size, np.int64), np.zeros(size)
            np.add.at(links, a, sets["k"][b])
            np.add.at(links, b, sets["k"][a])
            alike = both / (sets["n"][a] + sets["n"][b] - both)
            np.maximum.at(closest, a, alike)
            np.maximum.at(closest, b, alike)
            k = links > 0
            root = sets["cls"][_labels(size, a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(c[k]) for c in (sets["cls"], root, links, closest)], ["cls", "root", "links", "closest"])

    return members, shared.written(work.mapInArrow(run, "cls long, root long, links long, closest double"), "jaccard-links")


def class_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, cls), and every link between two classes as (cls_a, cls_b, jaccard).

    For callers who need the pairs themselves: their number may grow with the square of a group.
    """
    members, work = _prepared(docs, n, threshold, block_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _tasks(batches):
            sets, a, b, both = _linked(groups, threshold)
            alike = both / (sets["n"][a] + sets["n"][b] - both)
            yield pa.RecordBatch.from_arrays([pa.array(sets["cls"][a]), pa.array(sets["cls"][b]), pa.array(alike)], ["cls_a", "cls_b", "jaccard"])

    return members, work.mapInArrow(run, "cls_a long, cls_b long, jaccard double")


def _groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, class_id): the least document of everything that a class is connected to; texts of one id are connected."""
    several = members.groupBy("doc_id").agg(F.min("cls").alias("b"), F.max("cls").alias("m")).filter("b <> m").select("doc_id", "b")
    same = members.join(several, "doc_id").select(F.col("cls").alias("a"), "b")
    found = stars(links.select(F.col("cls").alias("a"), F.col("root").alias("b")).unionByName(same))
    rooted = members.join(found.select(F.col("a").alias("cls"), F.col("b").alias("root")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rooted.select("cls", "root").distinct().join(least, "root").select("cls", "class_id")


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, class_id, set_id, n_links, closest) of every document that is linked to another.

    ``class_id`` is the least document of the connected documents, ``set_id`` the
    least one with an equal set, ``n_links`` the number of documents whose sets
    reach the threshold with this one, copies included, and ``closest`` the
    largest similarity among them.  A document without a row has no link.

    A text of fewer than ``n`` words has one gram, all its words.  Null ids, null
    texts and texts without words have no link, nor has an empty table; repeated
    rows count once; other columns are ignored.  Texts of any length are taken
    whole.  Where a doc_id has several texts, each is a document of its own with
    its own row, and all are in one class.
    """
    members, linked = class_links(docs, n, threshold, block_items)
    sums = linked.groupBy("cls").agg(F.sum("links").alias("links"), F.max("closest").alias("closest"))
    copies = members.groupBy("cls").agg(F.count("*").alias("k"), F.min("doc_id").alias("set_id"))
    per_class = copies.join(sums, "cls", "left").withColumn("n_links", F.col("k") - 1 + F.coalesce("links", F.lit(0))).filter("n_links > 0")
    per_class = per_class.withColumn("closest", F.when(F.col("k") > 1, F.lit(1.0)).otherwise(F.col("closest"))).join(_groups(members, linked), "cls")
    return members.join(per_class, "cls").select("doc_id", "class_id", "set_id", "n_links", "closest")


def drop_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` with one document of each class, the one of the least doc_id.

    A class is a connected component of the links.  Documents without links stay,
    as do those with a null id, a null text or no words.  Rows of one doc_id, which
    are in one class, stay or go together.
    """
    members, linked = class_links(docs, n, threshold, block_items)
    gone = members.join(_groups(members, linked), "cls").filter("doc_id <> class_id").select("doc_id")
    return shared.without_ids(docs, shared.written(gone.distinct(), "near-copies"))
