"""Lookups: single rows, searches, documents of entities and connections, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


class NotFoundError(LookupError):
    """No row has the id that was asked for."""


#: Ids in a literal list; more are joined.
LITERAL_IDS = 1000


def has_id(rows: DataFrame, column: str, ids: list, wanted: bool = True) -> DataFrame:
    """The rows whose ``column`` is (or isn't) one of ``ids``: a literal list, or a join for a long one."""
    if len(ids) <= LITERAL_IDS:
        hit = F.col(column).isin(*ids)
        return rows.filter(hit if wanted else ~hit)
    return rows.join(_id_table(rows, column, ids), column, "left_semi" if wanted else "left_anti").select(*rows.columns)


def with_flag(rows: DataFrame, column: str, ids: list, name: str) -> DataFrame:
    """``rows`` with a boolean column: whether ``column`` is one of ``ids``."""
    if len(ids) <= LITERAL_IDS:
        return rows.withColumn(name, F.col(column).isin(*ids) if ids else F.lit(False))
    known = _id_table(rows, column, ids).withColumn(name, F.lit(True))
    return rows.join(known, column, "left").select(*rows.columns, F.coalesce(name, F.lit(False)).alias(name))


def _id_table(rows: DataFrame, column: str, ids: list) -> DataFrame:
    return rows.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"`{column}` {dict(rows.dtypes)[column]}")


def page(rows: DataFrame, order: list, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of ordered rows."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def docs_by_focus(annotations: DataFrame, column: str, focus: list) -> DataFrame:
    """(doc_id, n_matched, matched): documents by how many of the focus targets they mention, most first."""
    found = has_id(annotations, column, focus).select("doc_id", column).distinct()
    return found.groupBy("doc_id").agg(F.count("*").alias("n_matched"), F.sort_array(F.collect_list(column)).alias("matched")).orderBy(F.desc("n_matched"), "doc_id")


def get_single(rows: DataFrame, id_, key: str = "id") -> Row:
    found = rows.filter(F.col(key) == id_).head()
    if found is None:
        raise NotFoundError(f"no {key} {id_!r}")
    return found


def get_multiple(rows: DataFrame, ids: list | None = None, limit: int | None = None, key: str = "id") -> DataFrame:
    """Rows of the given ids (all without them); ids that don't exist are passed over."""
    out = rows if ids is None else has_id(rows, key, ids)
    return out if limit is None else out.orderBy(key).limit(limit)


def labels_by_ids(nodes: DataFrame, ids: list) -> DataFrame:
    return has_id(nodes, "id", ids).select("id", "label")


def search(nodes: DataFrame, term: str, limit: int | None = None) -> DataFrame:
    """(id, label, frequency, rank) of labels that hold the term, without case; % and _ are wildcards.

    Exact matches come first, then beginnings, then the rest; by frequency, length and label.
    """
    low = F.lower("label")
    rank = F.when(low == term.lower(), 0).when(low.startswith(term.lower()), 1).otherwise(2)
    out = nodes.filter(F.col("label").ilike(f"%{term}%")).select("id", "label", "frequency", rank.alias("rank"))
    ordered = out.orderBy("rank", F.desc("frequency"), F.length("label"), "label")
    return ordered if limit is None else ordered.limit(limit)


def doc_ids_of(annotations: DataFrame, condition: Column, limit: int | None = None) -> DataFrame:
    """The distinct documents of some annotations; a limit counts documents."""
    out = annotations.filter(condition).select("doc_id").distinct()
    return out if limit is None else out.orderBy("doc_id").limit(limit)


def doc_ids_by_entities(tuplets: DataFrame, ids: list, one: str = "entity_one", two: str = "entity_two") -> DataFrame:
    """Documents with a tuplet both of whose ends are among the entities."""
    return among(tuplets, ids, [one, two]).select("doc_id").distinct()


def among(rows: DataFrame, ids: list, columns: list[str]) -> DataFrame:
    """Rows whose given columns are all among the entities."""
    for c in columns:
        rows = has_id(rows, c, ids)
    return rows


def with_annotations(docs: DataFrame, **annotations: DataFrame) -> DataFrame:
    """Documents with an array column for each kind of annotation, empty where there is none."""
    out = docs
    for name, rows in annotations.items():
        own = [c for c in rows.columns if c != "doc_id"]
        packed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*own))).alias(name))
        out = out.join(packed, "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast(dict(packed.dtypes)[name])))
    return out


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """``df`` without the columns that are null in every row, found by one aggregation."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[f"`{c}`" for c in df.columns if counts[c]])


def export(targets: DataFrame, keys: list[str], alt: DataFrame | None = None, pivot: DataFrame | None = None) -> DataFrame:
    """A table of targets with their other wordings and one column per category, without empty columns."""
    out = targets
    for extra in (alt, pivot):
        if extra is not None:
            out = out.join(extra, [k for k in keys if k in extra.columns], "left")
    return drop_empty_columns(out)


def mention_table(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every mention with the id of its entity."""
    return mentions.join(nodes.select("label", F.col("id").alias("entity_id")), "label").withColumnRenamed("label", "entity_label")


def with_frequencies(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Co-occurrences or relations with the frequencies of their two ends."""
    ends = ("entity_one", "entity_two") if "entity_one" in pairs.columns else ("subject", "object")
    for end in ends:
        pairs = pairs.join(nodes.select(F.col("label").alias(end), F.col("frequency").alias(f"{end}_frequency")), end)
    return pairs


def with_ends(rows: DataFrame, nodes: DataFrame, ends: dict[str, str]) -> DataFrame:
    """``rows`` with the id of the entity in each of some label columns: ``ends`` names the id columns."""
    for label, name in ends.items():
        rows = rows.join(nodes.select(F.col("label").alias(label), F.col("id").alias(name)), label)
    return rows


def triplet_table(triplets: DataFrame, nodes: DataFrame, predicates: DataFrame) -> DataFrame:
    """Every triplet with ids, labels and spans of its three parts."""
    rows = with_ends(with_ends(triplets, nodes, {"subject": "subject_entity_id", "object": "object_entity_id"}), predicates, {"predicate": "predicate_id"})
    return rows.select(
        "doc_id", "subject_entity_id", F.col("subject").alias("subject_label"), *[F.col(f"subj_{c}").alias(f"subject_span_{c}") for c in ("text", "start", "end")],
        "predicate_id", F.col("predicate").alias("predicate_label"), F.col("pred_text").alias("pred_span_text"),
        "object_entity_id", F.col("object").alias("object_label"), *[F.col(f"obj_{c}").alias(f"object_span_{c}") for c in ("text", "start", "end")],
    )


def tuplet_table(tuplets: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Every tuplet with ids, labels and spans of its two ends, as they stand in the text.

    Without ``nodes`` the tuplets have the ids already.
    """
    rows = tuplets if nodes is None else with_ends(tuplets, nodes, {"one_label": "entity_one_id", "two_label": "entity_two_id"})
    return rows.select("doc_id", *[c for k in ("one", "two") for c in (f"entity_{k}_id", F.col(f"{k}_label").alias(f"entity_{k}_label"), *[F.col(f"{k}_{x}").alias(f"entity_{k}_span_{x}") for x in ("text", "start", "end")])])


def details(targets: DataFrame, cats: DataFrame, alt: DataFrame, stats: tuple[str, ...]) -> DataFrame:
    """(id, label, alt_labels, categories, stats): one struct of statistics and one map of categories for each target."""
    values = cats.groupBy("id", "name").agg(F.sort_array(F.collect_set("value")).alias("v")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "v")))).alias("categories"))
    keys = [c for c in targets.columns if c in alt.columns]
    joined = targets.join(alt, keys, "left").join(values, "id", "left")
    labels = [c for c in targets.columns if c != "id" and c not in stats]
    return joined.select("id", *labels, F.coalesce("alt_labels", F.array().cast("array<string>")).alias("alt_labels"), F.coalesce("categories", F.create_map().cast("map<string,array<string>>")).alias("categories"), F.struct(*stats).alias("stats"))


def document_categories(docs: DataFrame) -> DataFrame:
    """Documents with one column of sorted values for each category name in place of the map."""
    names = [r["name"] for r in docs.select(F.explode(F.map_keys("categories")).alias("name")).distinct().orderBy("name").collect()]
    plain = [c for c in docs.columns if c != "categories"]
    return docs.select(*plain, *[F.coalesce(F.sort_array(F.array_distinct(F.element_at("categories", n))), F.array().cast("array<string>")).alias(n) for n in names])


def metadata_map(rows: DataFrame) -> DataFrame:
    """(doc_id, metadata): rows (doc_id, name, value) as one map for each document."""
    return rows.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("value").cast("string"))))).alias("metadata"))
