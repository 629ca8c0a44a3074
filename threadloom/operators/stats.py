"""Corpus statistics of entities, predicates, relations and co-occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATS = ("frequency", "doc_frequency", "adjusted_tf_idf", "first_occurrence", "last_occurrence", "first_occurrence_ordinal", "last_occurrence_ordinal")


DATES = ("timestamp", "timestamp_ordinal")


def text_stats(annotations: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys + STATS of annotated targets; ``annotations`` has doc_id and the keys.

    Frequency counts annotations, doc_frequency documents; occurrence bounds skip
    nulls; adjusted_tf_idf = (frequency - 1) * documents / (doc_frequency + 1).

    Annotations are first counted by key and document, which halves what follows
    and needs no expansion for a distinct count.  Where they carry their documents'
    dates, as extraction can, the documents aren't joined.
    """
    carried = all(c in annotations.columns for c in DATES)
    per_doc = annotations.groupBy(*keys, "doc_id").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in DATES if carried])
    dated = per_doc if carried else per_doc.join(docs.select("doc_id", *DATES), "doc_id")
    grouped = dated.groupBy(*keys).agg(
        F.sum("n").alias("frequency"),
        F.count("*").alias("doc_frequency"),
        F.min("timestamp").alias("first_occurrence"),
        F.max("timestamp").alias("last_occurrence"),
        F.min("timestamp_ordinal").alias("first_occurrence_ordinal"),
        F.max("timestamp_ordinal").alias("last_occurrence_ordinal"),
    )
    return with_tf_idf(grouped, docs, keys)


def with_tf_idf(grouped: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys + STATS of targets that have all but the adjusted_tf_idf."""
    total = docs.agg(F.count("*").alias("n_docs"))  # one row
    tf_idf = (F.col("frequency") - 1) * (F.col("n_docs") / (F.col("doc_frequency") + 1))
    return grouped.crossJoin(F.broadcast(total)).withColumn("adjusted_tf_idf", tf_idf).select(*keys, *STATS)


def union_columns(annotations: DataFrame, columns: list[str], name: str) -> DataFrame:
    """One row (doc_id, name) for each of several columns that refer to the same kind of target."""
    kept = [c for c in ("doc_id", *DATES) if c in annotations.columns]
    return annotations.select(*kept, F.explode(F.array(*columns)).alias(name))


def with_defaults(targets: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Targets without annotations get -1 for their counts and scores."""
    joined = targets.join(stats, keys, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(-1)) for c in STATS[:3]})


def pmi(pairs: DataFrame, entities: DataFrame, frequencies: bool = False) -> DataFrame:
    """``pairs`` (entity_one, entity_two, frequency, ...) with pmi, to base 10 and over the mentions of all entities.

    With ``frequencies`` also entity_one_frequency and entity_two_frequency.  The
    entities are few beside the pairs, so theirs is the side that is hashed and
    the pairs aren't sorted.
    """
    freq = entities.select("label", "frequency").hint("shuffle_hash")
    one = freq.select(F.col("label").alias("entity_one"), F.col("frequency").alias("entity_one_frequency"))
    two = freq.select(F.col("label").alias("entity_two"), F.col("frequency").alias("entity_two_frequency"))
    total = entities.agg(F.sum("frequency").alias("__n"))  # one row
    value = F.log10("frequency") + F.log10("__n") - F.log10("entity_one_frequency") - F.log10("entity_two_frequency")
    joined = pairs.join(one, "entity_one").join(two, "entity_two").crossJoin(F.broadcast(total))
    added = ["entity_one_frequency", "entity_two_frequency"] if frequencies else []
    return joined.withColumn("pmi", value).select(*pairs.columns, *added, "pmi")


def significance(relations: DataFrame, predicates: DataFrame) -> DataFrame:
    """``relations`` (subject, predicate, object, frequency, ...) with their significance, to base 10."""
    p = predicates.select(F.col("label").alias("predicate"), F.col("frequency").alias("__fp"))
    total = predicates.agg(F.sum("frequency").alias("__n"))  # one row
    pair = F.sum("frequency").over(Window.partitionBy("subject", "object"))
    value = F.log10("frequency") - F.log10(pair) - F.log10("__fp") + F.log10("__n")
    return relations.join(p, "predicate").crossJoin(F.broadcast(total)).withColumn("significance", value).select(*relations.columns, "significance")


def categories(docs: DataFrame) -> DataFrame:
    """(doc_id, name, value) of the documents' map of category names to values."""
    return docs.select("doc_id", F.explode("categories").alias("name", "values")).select("doc_id", "name", F.explode("values").alias("value"))


def target_categories(annotations: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys + (name, value): the categories of the documents that mention a target, each once."""
    return annotations.select("doc_id", *keys).distinct().join(categories(docs), "doc_id").select(*keys, "name", "value").distinct()


def category_pivot(cats: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One column for each of the given category names with the sorted values of each target."""
    wide = cats.groupBy(*keys).pivot("name", names).agg(F.sort_array(F.collect_set("value")))
    return wide.select(*keys, *[F.coalesce(n, F.array().cast("array<string>")).alias(n) for n in names])


def alt_labels(annotations: DataFrame, key: str, text: str) -> DataFrame:
    """(key, alt_labels): the other wordings of each target, sorted."""
    other = annotations.filter(F.col(text) != F.col(key))
    return other.groupBy(key).agg(F.sort_array(F.collect_set(text)).alias("alt_labels"))


def bounds(docs: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the ranges of dates, ordinals, node and edge frequencies."""
    d = docs.agg(*[f(c).alias(f"{n}_{c}") for c in ("timestamp", "timestamp_ordinal") for n, f in (("min", F.min), ("max", F.max))])
    n = entities.agg(F.min("frequency").alias("min_node_frequency"), F.max("frequency").alias("max_node_frequency"))
    e = edges.agg(F.min("frequency").alias("min_edge_frequency"), F.max("frequency").alias("max_edge_frequency"))
    return d.crossJoin(n).crossJoin(e)  # one row each


def category_values(docs: DataFrame) -> DataFrame:
    """(name, values): the sorted values of each category name."""
    return categories(docs).groupBy("name").agg(F.sort_array(F.collect_set("value")).alias("values"))


def connection_types(relations: DataFrame | None) -> list[str]:
    return ["cooccurrence"] if relations is None or relations.isEmpty() else ["relation", "cooccurrence"]


def combine_category_maps(a: Column, b: Column) -> Column:
    """The union of two maps of names to values."""
    empty = F.array().cast("array<string>")
    return F.map_zip_with(a, b, lambda _, x, y: F.array_union(F.coalesce(x, empty), F.coalesce(y, empty)))
