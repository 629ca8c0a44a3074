"""Communities of the co-occurrence graph and their metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import filters
from .filters import GraphFilter
from .mapping import ranked_ids


def community_graph(nodes: DataFrame, rows: DataFrame, f: GraphFilter = GraphFilter(), weight: str = "pmi", min_weight: float = 0.0, node_cats: DataFrame | None = None, edge_cats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The vertices (id) and edges (a, b, weight; a < b) that communities are found in.

    ``min_weight`` is a bound on PMI, also where frequency is the weight.
    """
    if weight not in ("pmi", "frequency"):
        raise ValueError(f"unknown weight: {weight}")
    v = filters.entities(nodes, f, node_cats).select("id")
    e = filters.edges(rows, f, edge_cats).filter(F.col("pmi") >= min_weight)
    e = e.join(v.select(F.col("id").alias("source")), "source", "left_semi").join(v.select(F.col("id").alias("target")), "target", "left_semi")
    return v, e.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.col(weight).cast("double").alias("weight"))


#: Vertices or edges that a custom algorithm may bring to the driver.
DRIVER_ROWS = 5_000_000
#: Links up to which components are found in one task; the number is counted first.
ONE_TASK_LINKS = 1_000_000
#: Edges of a component up to which one task holds them as numbers, in some 2 GB at most; and arcs that it looks at together.
ARRAY_EDGES = 16_000_000
BLOCK_ARCS = 1 << 20


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): every node of the links with the least node that it is connected to."""
    parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not parts:
        return
    x, y = (np.concatenate(c) for c in zip(*parts))
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y, label = at[: len(x)], at[len(x) :], np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, label[x], label[y])
        np.minimum.at(least, label[y], label[x])
        while (jump := least[least]).tobytes() != least.tobytes():
            least = jump
        new = least[label]
        if (new == label).all():
            break
        label = new
    inner = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(nodes[label[inner]])], ["a", "b"])


def _mark(links: DataFrame) -> tuple:
    """What tells two sets of links apart: their number and a hash of them all."""
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def stars(edges: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(a, b): every node of the edges (a, b) that isn't the least of its component, with the least.

    Up to ``one_task`` links, which are counted, are joined up in one task; more
    by alternating large-star and small-star steps (Kiveris et al., 2014), whose
    rounds grow with the logarithm of the longest path.  Each round is written
    once and compared with the last by one hash of all links.
    """
    links = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    mark = _mark(links)
    if mark[0] <= one_task:
        return links.coalesce(1).mapInArrow(_in_one_task, links.schema) if mark[0] else links
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        new = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        links = written(new, "components")
        last, mark = mark, _mark(links)
        if mark == last:
            return links


def connected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, id): connected components, named by their least member; single vertices too."""
    links = stars(edges)
    return vertices.join(links.withColumnRenamed("a", "id"), "id", "left").select(F.coalesce("b", "id").alias("community"), "id")


def k_cliques(edges: DataFrame, k: int) -> DataFrame:
    """(members): all cliques of k vertices, by joins along edges that point to the vertex of more neighbours."""
    if k < 2:
        raise ValueError("k must be at least 2")
    e = edges.filter("a <> b").select("a", "b").distinct()
    degree = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    d1, d2 = degree.select(F.col("id").alias("a"), F.col("d").alias("da")), degree.select(F.col("id").alias("b"), F.col("d").alias("db"))
    first = F.struct("da", "a") < F.struct("db", "b")
    arcs = e.join(d1, "a").join(d2, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"))
    out = arcs.select(F.array("x", "y").alias("members"))
    for size in range(2, k):
        grown = out.join(arcs, F.element_at("members", -1) == F.col("x")).select("members", F.col("y").alias("new"))
        for i in range(size - 1):
            check = arcs.select(F.col("x").alias("old"), F.col("y").alias("new"))
            grown = grown.withColumn("old", F.get("members", F.lit(i))).join(check, ["old", "new"], "left_semi").select("members", "new")
        out = grown.select(F.array_append("members", F.col("new")).alias("members"))
    return out.select(F.array_sort("members").alias("members"))


def clique_percolation(edges: DataFrame, k: int = 3) -> DataFrame:
    """(community, id): unions of k-cliques that are linked by sharing k-1 vertices; they may overlap.

    A community is named by the least of its cliques.
    """
    cliques = written(k_cliques(edges, k).select(F.array_join(F.transform("members", lambda m: m.cast("string")), "\u0001").alias("clique"), "members"), "cliques")
    faces = cliques.select("clique", "members", F.explode("members").alias("left_out")).select(
        "clique", F.array_remove("members", F.col("left_out")).alias("face")
    )
    # all cliques of a face are linked to its least one, so the links are as many as the faces
    hub = faces.groupBy("face").agg(F.min("clique").alias("hub"))
    links = faces.join(hub, "face").filter("clique <> hub").select(F.col("clique").alias("a"), F.col("hub").alias("b"))
    found = connected(cliques.select(F.col("clique").alias("id")), links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return found.withColumnRenamed("id", "clique").join(cliques, "clique").select("community", F.explode("members").alias("id")).distinct()


def louvain_partition(edges: list[tuple], resolution: float = 1.0) -> dict:
    """Louvain's method on one graph of (a, b, weight), with vertices in sorted order, so that results repeat."""
    graph: dict = {}
    for a, b, w in edges:
        graph.setdefault(a, {})[b] = graph.get(a, {}).get(b, 0.0) + w
        if a != b:
            graph.setdefault(b, {})[a] = graph.get(b, {}).get(a, 0.0) + w
    member = {v: v for v in graph}
    while True:
        strength = {v: sum(n.values()) + n.get(v, 0.0) for v, n in graph.items()}
        total = sum(strength.values())
        if total <= 0:
            break
        own = {v: v for v in graph}
        inside = dict(strength)
        moved, moved_any = True, False
        while moved:
            moved = False
            for v in sorted(graph):
                here = own[v]
                inside[here] -= strength[v]
                near: dict = {here: 0.0}
                for u, w in graph[v].items():
                    if u != v:
                        near[own[u]] = near.get(own[u], 0.0) + w
                score = {c: near[c] - resolution * strength[v] * inside.get(c, 0.0) / total for c in sorted(near)}
                best = max(score, key=score.get)
                if score[best] <= score[here] + 1e-9:  # a move must gain more than rounding can, so this comes to an end
                    best = here
                inside[best] = inside.get(best, 0.0) + strength[v]
                if best != here:
                    own[v], moved, moved_any = best, True, True
        if not moved_any:
            break
        member = {v: own[c] for v, c in member.items()}
        merged: dict = {}
        for v, near in graph.items():
            for u, w in near.items():
                if u >= v:
                    a, b = own[v], own[u]
                    merged[min(a, b), max(a, b)] = merged.get((min(a, b), max(a, b)), 0.0) + w
        graph = {}
        for (a, b), w in merged.items():
            graph.setdefault(a, {})[b] = w
            graph.setdefault(b, {})[a] = w
    return member


def _in_blocks(u: np.ndarray, v: np.ndarray, w: np.ndarray, loop: np.ndarray, resolution: float) -> np.ndarray:
    """The community of each vertex after moving single vertices: block by block, of each block about half at once.

    Arcs u -> v come in both directions, sorted by u; ``loop`` is the weight of
    each vertex's loop.  A block sees where those before it have gone.  The rounds
    end when three of them have not made the modularity better; the best partition is given.
    """
    n = len(loop)
    off = np.searchsorted(u, np.arange(n + 1))
    k = np.bincount(u, w, n) + 2 * loop
    m2 = k.sum()
    if m2 <= 0:
        return np.arange(n)
    cuts = np.unique(np.append(np.searchsorted(off, np.arange(0, len(u), max(1, min(BLOCK_ARCS, len(u) // 16))), side="right") - 1, n))
    own, total = np.arange(n), k.copy()
    best, best_own, stale, chance = -np.inf, own.copy(), 0, np.random.default_rng(0)
    while stale < 3:
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            x, c, weight = u[off[first] : off[last]] - first, own[v[off[first] : off[last]]], w[off[first] : off[last]]
            here, size = own[first:last], last - first
            # staying is a choice too, without an arc
            x, c, weight = np.append(x, np.arange(size)), np.append(c, here), np.append(weight, np.zeros(size))
            key = x.astype(np.int64) * n + c
            order = np.argsort(key)
            key = key[order]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, weight = key[at], np.add.reduceat(weight[order], at)
            x, c = key // n, key % n
            own_k, stays = k[first:last][x], c == here[x]
            gain = weight - resolution * own_k * (total[c] - np.where(stays, own_k, 0.0)) / m2
            begin = np.searchsorted(x, np.arange(size))
            top = np.maximum.reduceat(gain, begin)
            hit = np.flatnonzero(gain == top[x])
            to = c[hit[np.searchsorted(x[hit], np.arange(size))]]
            goes = np.flatnonzero((top > gain[stays] + 1e-9) & (chance.random(size) < 0.5))
            if len(goes):
                moved = first + goes
                total += np.bincount(to[goes], k[moved], n) - np.bincount(own[moved], k[moved], n) if len(goes) > n // 64 else 0.0
                if len(goes) <= n // 64:
                    np.subtract.at(total, own[moved], k[moved])
                    np.add.at(total, to[goes], k[moved])
                own[moved] = to[goes]
        total = np.bincount(own, k, n)
        inner = 2 * loop.sum() + sum(w[i : i + BLOCK_ARCS][own[u[i : i + BLOCK_ARCS]] == own[v[i : i + BLOCK_ARCS]]].sum() for i in range(0, len(u), BLOCK_ARCS))
        value = inner / m2 - resolution * ((total / m2) ** 2).sum()
        better = value > best + 1e-6
        best, best_own, stale = (value, own.copy(), 0) if better else (best, best_own, stale + 1)
    return best_own


def louvain_of_arrays(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, resolution: float = 1.0) -> np.ndarray:
    """Louvain's method on the edges (a, b, w) of the vertices 0 to n - 1: for each vertex the least of its community.

    Takes some hundred bytes for each edge.
    """
    member = np.arange(n)
    loop = np.bincount(a[a == b], w[a == b], n)
    a, b, w = a[a != b], b[a != b], w[a != b]
    u, v, w = _merged(np.append(a, b), np.append(b, a), np.append(w, w), n)
    while True:
        own = _in_blocks(u, v, w, loop, resolution)
        names, own = np.unique(own, return_inverse=True)
        if len(names) == n:
            break
        member, n = own[member], len(names)
        c, d = own[u], own[v]
        loop = np.bincount(own, loop, n) + np.bincount(c[c == d], w[c == d], n) / 2  # an inner edge comes twice
        u, v, w = _merged(c[c != d], d[c != d], w[c != d], n)
    least = np.full(n, len(member))
    np.minimum.at(least, member, np.arange(len(member)))
    return least[member]


def _merged(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> tuple:
    """Arcs sorted, each once with the sum of its weights."""
    key = u.astype(np.int64) * n + v
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    key = key[at]
    kind = np.int32 if n < 2**31 else np.int64
    return (key // n).astype(kind), (key % n).astype(kind), np.add.reduceat(w[order], at) if len(at) else w[:0]


def _moved(arcs: DataFrame, resolution: float) -> DataFrame:
    """(u, c): a local optimum of moving single vertices, by rounds in which about half of them may move at once.

    ``arcs`` has (root, u, v, w), both directions, a loop once.  The rounds end when
    three of them have not made the modularity better; the best partition is given.
    """
    strength = arcs.groupBy("root", "u").agg(F.sum(F.when(F.col("u") == F.col("v"), 2 * F.col("w")).otherwise(F.col("w"))).alias("k"))
    strength = written(strength.join(strength.groupBy("root").agg(F.sum("k").alias("m2")), "root"), "strengths").hint("merge")
    own = written(strength.select("u", F.col("u").alias("c")), "moves").hint("merge")  # a broadcast in every round would all go by way of the driver
    best, best_own, stale, round_ = float("-inf"), own, 0, 0
    while stale < 3:
        at = strength.join(own, "u")
        total = at.groupBy("c").agg(F.sum("k").alias("t"))
        near = arcs.filter("u <> v").join(own.select(F.col("u").alias("v"), "c"), "v").select("u", "c", "w")
        near = near.unionByName(own.select("u", "c", F.lit(0.0).alias("w"))).groupBy("u", "c").agg(F.sum("w").alias("w"))
        scored = near.join(total.hint("merge"), "c").join(at.select("u", "k", "m2", F.col("c").alias("here")), "u")
        rest = F.col("t") - F.when(F.col("c") == F.col("here"), F.col("k")).otherwise(0.0)
        scored = scored.withColumn("gain", F.col("w") - resolution * F.col("k") * rest / F.col("m2"))
        chosen = scored.groupBy("u").agg(F.max("here").alias("here"), F.max("gain").alias("top"), F.min_by("c", F.struct(-F.col("gain"), "c")).alias("to"), F.max(F.when(F.col("c") == F.col("here"), F.col("gain"))).alias("stay"))
        goes = (F.col("top") > F.col("stay") + 1e-9) & (F.pmod(F.xxhash64("u", F.lit(round_)), F.lit(2)) == 0)
        own = written(chosen.select("u", F.when(goes, F.col("to")).otherwise(F.col("here")).alias("c")), "moves").hint("merge")
        ends = arcs.join(own, "u").join(own.select(F.col("u").alias("v"), F.col("c").alias("d")), "v")
        inner = ends.filter("c = d").groupBy("root").agg(F.sum(F.when(F.col("u") == F.col("v"), 2 * F.col("w")).otherwise(F.col("w"))).alias("inner"))
        sums = strength.join(own, "u").groupBy("root", "m2", "c").agg(F.sum("k").alias("t")).groupBy("root", "m2").agg(F.sum((F.col("t") / F.col("m2")) ** 2).alias("squares"))
        value = sums.join(inner, "root", "left").agg(F.sum(F.coalesce("inner", F.lit(0.0)) / F.col("m2") - resolution * F.col("squares"))).first()[0] or 0.0
        better = value > best + 1e-7
        best, best_own, stale = (value, own, 0) if better else (best, best_own, stale + 1)
        round_ += 1
    return best_own


def _louvain_by_rounds(placed: DataFrame, resolution: float) -> DataFrame:
    """(community, id) of the edges (root, a, b, weight): local moving and merging, all by joins and aggregations."""
    edge = placed.select("root", F.col("a").alias("u"), F.col("b").alias("v"), F.col("weight").alias("w"))
    arcs = edge.unionByName(edge.filter("u <> v").select("root", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    arcs = written(arcs.groupBy("root", "u", "v").agg(F.sum("w").alias("w")), "arcs")
    member = written(arcs.select(F.col("u").alias("id"), F.col("u").alias("community")).distinct(), "members")
    while True:
        own = _moved(arcs, resolution)
        if not own.filter("u <> c").limit(1).count():
            break
        member = written(member.join(own.withColumnRenamed("u", "community"), "community").select("id", F.col("c").alias("community")), "members")
        ends = arcs.join(own, "u").join(own.select(F.col("u").alias("v"), F.col("c").alias("d")), "v")
        half = F.when((F.col("c") == F.col("d")) & (F.col("u") != F.col("v")), F.col("w") / 2).otherwise(F.col("w"))  # an inner edge comes twice, a loop once
        arcs = written(ends.groupBy("root", "c", "d").agg(F.sum(half).alias("w")).select("root", F.col("c").alias("u"), F.col("d").alias("v"), "w"), "arcs")
    least = member.groupBy("community").agg(F.min("id").alias("least"))
    return member.join(least, "community").select(F.col("least").alias("community"), "id")


def _louvain_in_arrays(placed: DataFrame, roots: DataFrame, resolution: float) -> DataFrame:
    """(community, id) of the edges (root, a, b, weight), each component as arrays of numbers in one task."""
    ids = roots.join(placed.select(F.col("root").alias("community")).distinct(), "community", "left_semi").select(F.col("id").alias("label"))
    names = written(ranked_ids(ids, ["label"]).select("label", F.col("id").cast("int").alias("number")), "numbers")

    def named(rows: DataFrame, column: str, name: str) -> DataFrame:
        return rows.join(names.select(F.col("label").alias(column), F.col("number").alias(name)), column).drop(column)

    def run(table: pa.Table) -> pa.Table:
        a, b, w = (table.column(c).to_numpy() for c in ("x", "y", "weight"))
        known = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
        a, b = np.searchsorted(known, a).astype(np.int32), np.searchsorted(known, b).astype(np.int32)
        del table
        return pa.table({"c": known[louvain_of_arrays(a, b, w, len(known), resolution)], "i": known})

    found = named(named(placed, "a", "x"), "b", "y").groupBy("root").applyInArrow(run, "c int, i int")
    for column, name in (("c", "community"), ("i", "id")):
        found = found.join(names.select(F.col("number").alias(column), F.col("label").alias(name)), column).drop(column)
    return found.select("community", "id")


def louvain(vertices: DataFrame, edges: DataFrame, resolution: float = 1.5, one_task: int = ONE_TASK_LINKS, in_arrays: int = ARRAY_EDGES) -> DataFrame:
    """(community, id) by Louvain's method, each connected component by itself; single vertices too.

    Components of up to ``one_task`` edges, which are counted, are each worked
    through by one task, vertex by vertex, and in parallel.  Those of up to
    ``in_arrays`` edges are held as arrays of numbers in one task, where the vertices
    move block by block; in larger ones they move in rounds of joins and
    aggregations, many at once.  Both may end in another optimum.  A community is
    named by its least member.
    """
    kind = dict(vertices.dtypes)["id"]
    roots = written(connected(vertices, edges), "roots")
    placed = edges.join(roots.withColumnRenamed("id", "a"), "a").select(F.col("community").alias("root"), "a", "b", "weight")
    large = written(placed.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > one_task), "large-components")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = louvain_partition(list(pdf[["a", "b", "weight"]].sort_values(["a", "b"]).itertuples(index=False, name=None)), resolution)
        least: dict = {}
        for v in sorted(found):
            least.setdefault(found[v], v)
        return pd.DataFrame({"community": [least[found[v]] for v in found], "id": list(found)})

    grouped = placed.join(large, "root", "left_anti").groupBy("root").applyInPandas(run, f"community {kind}, id {kind}")
    by_arrays, by_rounds = large.filter(F.col("n") <= in_arrays), large.filter(F.col("n") > in_arrays)
    if by_arrays.limit(1).count():
        grouped = grouped.unionByName(_louvain_in_arrays(written(placed.join(by_arrays, "root", "left_semi"), "large"), roots, resolution))
    if by_rounds.limit(1).count():
        grouped = grouped.unionByName(_louvain_by_rounds(written(placed.join(by_rounds, "root", "left_semi"), "large"), resolution))
    return vertices.join(grouped, "id", "left").select(F.coalesce("community", "id").alias("community"), "id")


def custom(vertices: DataFrame, edges: DataFrame, find: Callable[[pd.DataFrame, pd.DataFrame], list[set]]) -> DataFrame:
    """(community, id) by any function of the vertices and edges as pandas frames, on the driver.

    ValueError for more than DRIVER_ROWS vertices or edges, which the driver might not hold.
    """
    if max(vertices.count(), edges.count()) > DRIVER_ROWS:
        raise ValueError(f"a custom algorithm takes at most {DRIVER_ROWS} vertices and edges")
    spark, kind = vertices.sparkSession, dict(vertices.dtypes)["id"]
    rows = [(min(c), v) for c in find(vertices.toPandas(), edges.toPandas()) for v in sorted(c)]
    return spark.createDataFrame(rows, f"community {kind}, id {kind}")


def metrics(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, n_members, n_edges, density, avg_weight, conductance, score) of each community.

    conductance = cut edges / (cut edges + 2 inner edges); density is 0 for single
    vertices, avg_weight 0 without inner edges; score = density * (1 - conductance).
    """
    sizes = members.groupBy("community").agg(F.count("*").alias("n_members"))
    ends = edges.select("a", "b", "weight", F.explode(F.array("a", "b")).alias("id")).join(members, "id")
    per_edge = ends.groupBy("community", "a", "b").agg(F.count("*").alias("hits"), F.first("weight").alias("weight"))
    inner = F.col("hits") == 2
    sums = per_edge.groupBy("community").agg(
        F.count(F.when(inner, 1)).alias("n_edges"), F.count(F.when(~inner, 1)).alias("cut"), F.avg(F.when(inner, F.col("weight"))).alias("avg_weight")
    )
    n, e, c = F.col("n_members"), F.coalesce("n_edges", F.lit(0)), F.coalesce("cut", F.lit(0))
    density = F.when(n > 1, e / (n * (n - 1) / 2)).otherwise(0.0)
    conductance = F.when(c + 2 * e > 0, c / (c + 2 * e)).otherwise(0.0)
    out = sizes.join(sums, "community", "left").select("community", "n_members", e.alias("n_edges"), density.alias("density"), F.coalesce("avg_weight", F.lit(0.0)).alias("avg_weight"), conductance.alias("conductance"))
    return out.withColumn("score", F.col("density") * (1 - F.col("conductance")))


def inner_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, edges): the edges with both ends in a community, as sorted structs (a, b, weight)."""
    one, two = members.select("community", F.col("id").alias("a")), members.select("community", F.col("id").alias("b"))
    return edges.join(one, "a").join(two, ["community", "b"]).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("a", "b", "weight"))).alias("edges"))


def modularity(members: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity): one row, of a partition without overlap."""
    one, two = members.select(F.col("id").alias("a"), F.col("community").alias("ca")), members.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    placed = edges.join(one, "a").join(two, "b")
    half = placed.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "weight"), F.struct(F.col("cb").alias("c"), "weight"))).alias("x")).groupBy("x.c").agg(F.sum("x.weight").alias("s"))
    total = placed.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inner"))
    return half.crossJoin(total).agg((F.first("inner") / F.first("m") - resolution * F.sum((F.col("s") / (2 * F.col("m"))) ** 2)).alias("modularity"))


ALGORITHMS = ("louvain", "connected_components", "k_clique")


def find(vertices: DataFrame, edges: DataFrame, algorithm: str | Callable = "louvain", **options) -> DataFrame:
    """(community, id) by name of the algorithm or by a function, see ``custom``."""
    if callable(algorithm):
        return custom(vertices, edges, algorithm)
    if algorithm == "louvain":
        return louvain(vertices, edges, **options)
    if algorithm == "connected_components":
        return connected(vertices, edges)
    if algorithm == "k_clique":
        return clique_percolation(edges, **options)
    raise ValueError(f"unknown algorithm: {algorithm}")
