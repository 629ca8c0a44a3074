"""GraphFilter: the conditions of a graph query as conjunctions of columns."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookup


@dataclass(frozen=True)
class GraphFilter:
    """All conditions are optional; unknown names are refused by the constructor.

    Date and ordinal ranges are met by overlap with a target's first and last
    occurrence; a target without occurrences fails them.  An ordinal bound of 0 counts.
    """

    limit_nodes: int | None = None
    limit_edges: int | None = None
    minimum_node_frequency: int | None = None
    maximum_node_frequency: int | None = None
    minimum_node_doc_frequency: int | None = None
    maximum_node_doc_frequency: int | None = None
    minimum_edge_frequency: int | None = None
    maximum_edge_frequency: int | None = None
    minimum_edge_doc_frequency: int | None = None
    maximum_edge_doc_frequency: int | None = None
    earliest_date: dt.date | None = None
    latest_date: dt.date | None = None
    minimum_ordinal_time: int | None = None
    maximum_ordinal_time: int | None = None
    categories: dict[str, list[str]] | None = None
    blacklisted_entity_ids: list = field(default_factory=list)
    exclude_self_loops: bool = True

    @classmethod
    def parse(cls, values: dict) -> GraphFilter:
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown filters: {sorted(unknown)}")
        return cls(**values)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def in_range(column: str, low, high) -> list[Column]:
    return ([F.col(column) >= low] if low is not None else []) + ([F.col(column) <= high] if high is not None else [])


def overlaps(first: str, last: str, low, high) -> list[Column]:
    return ([F.col(last) >= low] if low is not None else []) + ([F.col(first) <= high] if high is not None else [])


def _in_time(f: GraphFilter) -> list[Column]:
    return overlaps("first_occurrence", "last_occurrence", f.earliest_date, f.latest_date) + overlaps(
        "first_occurrence_ordinal", "last_occurrence_ordinal", f.minimum_ordinal_time, f.maximum_ordinal_time
    )


def in_categories(rows: DataFrame, cats: DataFrame | None, keys: list[str], wanted: dict[str, list[str]] | None) -> DataFrame:
    """Rows that have, for every category name, one of its wanted values: one semi-join a name."""
    for name, values in (wanted or {}).items():
        if cats is None:
            raise ValueError("a category filter needs the table of categories")
        rows = rows.join(cats.filter((F.col("name") == name) & F.col("value").isin(*values)), keys, "left_semi")
    return rows


def entities(nodes: DataFrame, f: GraphFilter, cats: DataFrame | None = None) -> DataFrame:
    """The entities (id, ...) that pass the node conditions."""
    conditions = (
        in_range("frequency", f.minimum_node_frequency, f.maximum_node_frequency)
        + in_range("doc_frequency", f.minimum_node_doc_frequency, f.maximum_node_doc_frequency)
        + _in_time(f)
    )
    passing = nodes.filter(_all(conditions))
    if f.blacklisted_entity_ids:
        passing = lookup.has_id(passing, "id", list(f.blacklisted_entity_ids), wanted=False)
    return in_categories(passing, cats, ["id"], f.categories)


def edges(rows: DataFrame, f: GraphFilter, cats: DataFrame | None = None) -> DataFrame:
    """The connections (id, source, target, ...) that pass the edge conditions on their own statistics."""
    conditions = (
        in_range("frequency", f.minimum_edge_frequency, f.maximum_edge_frequency)
        + in_range("doc_frequency", f.minimum_edge_doc_frequency, f.maximum_edge_doc_frequency)
        + _in_time(f)
    )
    if f.exclude_self_loops:
        conditions.append(F.col("source") != F.col("target"))
    return in_categories(rows.filter(_all(conditions)), cats, ["id"], f.categories)
