"""Graph queries: top-k graphs, induced subgraphs, expansion, grouped edges.

Nodes are (id, label, frequency, ...); connections are (id, source, target,
frequency, ...), for relations also (predicate_label, significance).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters, lookup
from .filters import GraphFilter

EDGE = ("id", "source", "target", "label", "total_frequency")


def group_relations(rows: DataFrame) -> DataFrame:
    """One edge for each directed pair: summed frequency and the labels of its three most significant relations."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("significance")).alias("rank"), F.col("id").alias("id"), F.col("predicate_label").alias("label"))))
    grouped = rows.groupBy("source", "target").agg(F.sum("frequency").alias("total_frequency"), ordered.alias("parts"))
    label = F.concat(F.array_join(F.transform(F.slice("parts", 1, 3), lambda p: p["label"]), ", "), F.when(F.size("parts") > 3, ", ...").otherwise(""))
    return grouped.select(
        F.concat_ws("->", "source", "target").alias("id"), "source", "target", label.alias("label"), "total_frequency",
        F.transform("parts", lambda p: F.struct(p["id"].alias("id"), p["label"].alias("label"))).alias("group"),
    )


def plain_edges(rows: DataFrame) -> DataFrame:
    """Co-occurrences as edges, one to one and without a label."""
    return rows.select(F.col("id").cast("string").alias("id"), "source", "target", F.lit(None).cast("string").alias("label"), F.col("frequency").alias("total_frequency"))


def induced(nodes: DataFrame, rows: DataFrame, ids: DataFrame, f: GraphFilter, cats: DataFrame | None = None, relations: bool = False, focus: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) among the given ids: node limit, induced edges, edge limit, then nodes without an edge go.

    Focus nodes come first at the node limit, edges with more of them first at the
    edge limit, and they stay without an edge.  Node conditions are not applied
    here: the ids are taken as given.  Ties are broken by id.
    """
    focus = list(focus or [])
    chosen = lookup.with_flag(nodes.join(ids.select("id").distinct(), "id", "left_semi"), "id", focus, "__focus")
    if f.limit_nodes:
        chosen = chosen.orderBy(F.desc("__focus"), F.desc("frequency"), "id").limit(f.limit_nodes)
    passing = filters.edges(rows, f, cats)
    ends = chosen.select("id")
    inner = passing.join(ends.select(F.col("id").alias("source")), "source", "left_semi").join(ends.select(F.col("id").alias("target")), "target", "left_semi")
    found = group_relations(inner) if relations else plain_edges(inner)
    if f.limit_edges:
        marked = lookup.with_flag(lookup.with_flag(found, "source", focus, "__s"), "target", focus, "__t")
        hits = F.desc(F.col("__s").cast("int") + F.col("__t").cast("int"))
        found = marked.orderBy(hits, F.desc("total_frequency"), "source", "target").limit(f.limit_edges).drop("__s", "__t")
    connected = found.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    kept = chosen.join(connected.withColumn("__edge", F.lit(True)), "id", "left").filter("__focus OR __edge")
    return kept.drop("__focus", "__edge"), found


def top(nodes: DataFrame, rows: DataFrame, f: GraphFilter = GraphFilter(), node_cats: DataFrame | None = None, edge_cats: DataFrame | None = None, relations: bool = False) -> tuple[DataFrame, DataFrame]:
    """The graph of the most frequent entities that pass the filter."""
    passing = filters.entities(nodes, f, node_cats)
    if f.limit_nodes:
        passing = passing.orderBy(F.desc("frequency"), "id").limit(f.limit_nodes)
    return induced(nodes, rows, passing, replace(f, limit_nodes=None), edge_cats, relations)


def subgraph(nodes: DataFrame, rows: DataFrame, ids: list, f: GraphFilter = GraphFilter(), edge_cats: DataFrame | None = None, relations: bool = False) -> tuple[DataFrame, DataFrame]:
    """The induced graph of the given entities; only edge conditions apply."""
    return induced(nodes, rows, lookup.has_id(nodes, "id", ids), f, edge_cats, relations)


def expand(nodes: DataFrame, rows: DataFrame, focus: list, f: GraphFilter = GraphFilter(), node_cats: DataFrame | None = None, edge_cats: DataFrame | None = None, relations: bool = False) -> tuple[DataFrame, DataFrame]:
    """The focus entities, their neighbours that pass the node conditions, and all edges among them."""
    passing = filters.entities(nodes, f, node_cats).select("id")
    near = filters.edges(rows, f, edge_cats)
    out = lookup.has_id(near, "source", focus).select(F.col("target").alias("id"))
    into = lookup.has_id(near, "target", focus).select(F.col("source").alias("id"))
    ids = out.union(into).distinct().join(passing, "id", "left_semi").union(lookup.has_id(nodes, "id", focus).select("id")).distinct()
    return induced(nodes, rows, ids, f, edge_cats, relations, focus)
