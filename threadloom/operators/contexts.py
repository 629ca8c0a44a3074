"""Contexts and text segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(spans: DataFrame) -> DataFrame:
    """(doc_id, context_start, context_end): overlapping or touching spans of a document joined, each with its number of spans."""
    # equal spans are counted first, so that the order within a document is total
    distinct = spans.groupBy("doc_id", "context_start", "context_end").agg(F.count("*").alias("__n"))
    order = Window.partitionBy("doc_id").orderBy("context_start", "context_end")
    before = F.max("context_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = distinct.withColumn("__new", F.when(before >= F.col("context_start"), 0).otherwise(1))
    island = opened.withColumn("__island", F.sum("__new").over(order))
    return island.groupBy("doc_id", "__island").agg(F.min("context_start").alias("context_start"), F.max("context_end").alias("context_end"), F.sum("__n").alias("n_spans")).drop("__island")


def with_text(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans with their text, which is joined last; a null context is the whole document at offset 0."""
    start = F.coalesce("context_start", F.lit(0))
    body = F.when(F.col("context_start").isNull(), F.col("text")).otherwise(F.expr("substring(text, context_start + 1, context_end - context_start)"))
    return spans.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", start.alias("context_start"), body.alias("context"), *[c for c in spans.columns if c not in ("doc_id", "context_start", "context_end")])


def between_entities(rows: DataFrame, ids: list, one: str, two: str, keep_self: bool = False) -> DataFrame:
    """Tuplets or triplets whose both ends are among the given entities."""
    found = rows.filter(F.col(one).isin(*ids) & F.col(two).isin(*ids))
    return found if keep_self else found.filter(F.col(one) != F.col(two))


def grouped(rows: DataFrame, order_by: str) -> DataFrame:
    """Merged contexts with the rows that they hold, as an array ordered by a start offset."""
    islands = merged(rows.select("doc_id", "context_start", "context_end"))
    members = [c for c in rows.columns if c not in ("doc_id",)]
    inside = (F.col("r.context_start") >= F.col("i.context_start")) & (F.col("r.context_end") <= F.col("i.context_end"))
    joined = rows.alias("r").join(islands.alias("i"), (F.col("r.doc_id") == F.col("i.doc_id")) & inside)
    item = F.struct(F.col(f"r.{order_by}").alias("at"), F.struct(*[F.col(f"r.{c}").alias(c) for c in members]).alias("member"))
    packed = joined.groupBy(F.col("i.doc_id").alias("doc_id"), F.col("i.context_start").alias("context_start"), F.col("i.context_end").alias("context_end")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return packed.select("doc_id", "context_start", "context_end", F.transform("items", lambda x: x["member"]).alias("members"))


def segments(docs: DataFrame, highlights: DataFrame) -> DataFrame:
    """(doc_id, segment_start, segment_end, segment, roles): texts cut at every boundary of a highlight.

    ``highlights``: (doc_id, span_start, span_end, role).  ``roles`` are the sorted
    roles of the highlights that cover the segment.
    """
    texts = docs.select("doc_id", "text", F.length("text").alias("size"))
    cuts = (
        highlights.select("doc_id", F.explode(F.array("span_start", "span_end")).alias("at"))
        .unionByName(texts.select("doc_id", F.explode(F.array(F.lit(0), "size")).alias("at")))
        .join(texts.select("doc_id", "size"), "doc_id")
        .filter("at BETWEEN 0 AND size")
        .select("doc_id", "at")
        .distinct()
    )
    pieces = cuts.withColumn("end", F.lead("at").over(Window.partitionBy("doc_id").orderBy("at"))).filter("end IS NOT NULL")
    h = highlights.select(F.col("doc_id").alias("h_doc"), "span_start", "span_end", "role")
    covered = pieces.join(h, (F.col("doc_id") == F.col("h_doc")) & (F.col("span_start") <= F.col("at")) & (F.col("span_end") >= F.col("end")), "left")
    roles = covered.groupBy("doc_id", "at", "end").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    return roles.join(texts, "doc_id").select("doc_id", F.col("at").alias("segment_start"), F.col("end").alias("segment_end"), F.expr("substring(text, at + 1, end - at)").alias("segment"), "roles")


def entity_highlights(mentions: DataFrame, ids: list, primary: list | None = None) -> DataFrame:
    """(doc_id, span_start, span_end, role, primary) of the mentions of some entities (column ``label``)."""
    return mentions.filter(F.col("label").isin(*ids)).select("doc_id", "span_start", "span_end", F.lit("entity").alias("role"), F.col("label").isin(*(primary or ids)).alias("primary"))


def pair_highlights(tuplets: DataFrame, one: str, two: str) -> DataFrame:
    """Highlights of the two ends of the co-occurrences of two entities, in either order."""
    either = ((F.col("entity_one") == one) & (F.col("entity_two") == two)) | ((F.col("entity_one") == two) & (F.col("entity_two") == one))
    ends = F.array(*[F.struct(F.col(f"{k}_start").alias("span_start"), F.col(f"{k}_end").alias("span_end"), F.lit(f"entity_{k}").alias("role")) for k in ("one", "two")])
    return tuplets.filter(either).select("doc_id", F.inline(ends)).distinct().withColumn("primary", F.lit(True))


def relation_highlights(triplets: DataFrame, subject: str, predicate: str, obj: str) -> DataFrame:
    """Highlights of subject, predicate and object of one relation; the predicate's span may be missing."""
    own = triplets.filter((F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == obj))
    parts = F.array(*[F.struct(F.col(f"{k}_start").alias("span_start"), F.col(f"{k}_end").alias("span_end"), F.lit(r).alias("role")) for k, r in (("subj", "subject"), ("pred", "predicate"), ("obj", "object"))])
    return own.select("doc_id", F.inline(parts)).filter("span_start IS NOT NULL").distinct().withColumn("primary", F.lit(True))


_ANSI = {"both": "\033[35m", "subject": "\033[34m", "predicate": "\033[33m", "object": "\033[31m", "entity": "\033[34m"}


def ansi(segmented: DataFrame) -> DataFrame:
    """(doc_id, highlighted): the segments of a text joined again, coloured by role for a terminal."""
    roles = F.col("roles")
    paint = (
        F.when(F.array_contains(roles, "subject") & F.array_contains(roles, "object"), _ANSI["both"])
        .when(F.array_contains(roles, "subject"), _ANSI["subject"])
        .when(F.array_contains(roles, "predicate"), _ANSI["predicate"])
        .when(F.array_contains(roles, "object"), _ANSI["object"])
        .when(F.size(roles) > 0, _ANSI["entity"])
    )
    part = F.when(paint.isNull(), F.col("segment")).otherwise(F.concat(paint, F.col("segment"), F.lit("\033[0m")))
    ordered = F.array_sort(F.collect_list(F.struct("segment_start", part.alias("part"))))
    return segmented.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["part"]), "").alias("highlighted"))


def activation(members: DataFrame, context_members: DataFrame) -> DataFrame:
    """(community, activation): mean share of a community's members that are active in its contexts.

    ``context_members``: (context, id), one row for each entity that a context mentions.
    """
    size = members.groupBy("community").agg(F.count("*").alias("n"))
    active = context_members.distinct().join(members, "id").groupBy("community", "context").agg(F.count("*").alias("k"))
    return active.join(size, "community").groupBy("community").agg(F.avg(F.col("k") / F.col("n")).alias("activation"))
