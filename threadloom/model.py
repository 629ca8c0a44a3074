"""Models: fit a corpus once, then query its network."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import community, contexts, cooccur, extract, filters, graph, lookup, mapping, stats
from .operators.filters import GraphFilter
from .sources import store
from .sources.documents import HASHED, from_lists, numbered
from .sources.scratch import written


class CooccurrenceModel:
    """Entities and their co-occurrences.

    ``tables`` holds documents, mentions, tuplets, entities, cooccurrences and the
    categories of both; each is written once to the shared folder when fitted.
    ``coref`` makes clusters of mentions (see ``extract.resolve_pronouns``) from
    documents; pronouns then stand for their antecedents, and what they are
    resolved to takes no part in finding canonical labels.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, extractor: extract.Extractor = extract.capitalized, mapper: str | Callable = "subgram_lemmatization", window: int | None = 3, boundary: str = tx.BOUNDARY, coref: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.tables = spark, dict(tables or {})
        self.extractor, self.window, self.boundary, self.coref = extractor, window, boundary, coref
        #: What is saved with the model; functions aren't, and must be given again.
        self.options: dict[str, Any] = {"window": window, "boundary": boundary, "mapper": mapper if isinstance(mapper, str) else None}
        self.mapper = mapping.PRESETS[mapper] if isinstance(mapper, str) else mapper

    # fitting

    def fit(self, docs: DataFrame | list[str], **lists: Any) -> CooccurrenceModel:
        """Extract, map, count.

        Every document without an id is new, also one whose text is known; of those
        with an id, the ones that the model has already are passed over.
        """
        known = self.tables.get("documents")
        if not isinstance(docs, DataFrame):
            top = known.agg(F.max(F.when(F.col("doc_id") < HASHED, F.col("doc_id")))).first()[0] if known is not None else 0
            docs = from_lists(self.spark, docs, **lists, first_id=max(0, top or 0) + 1)
        blank = docs.filter("doc_id IS NULL")
        new = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
        if known is not None:
            new = new.join(known.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
        new = written(numbered(new.unionByName(blank), known), "documents")
        found = self._annotations(new)
        for name, rows in (("documents", new), *found.items()):
            rows = rows if rows is new else written(rows, name)
            self.tables[name] = self.tables[name].unionByName(rows, allowMissingColumns=True) if name in self.tables else rows
        self._aggregate()
        return self

    def _annotations(self, docs: DataFrame) -> dict[str, DataFrame]:
        spans = extract.mentions(docs, self.extractor)
        if self.coref is None:
            return {"mentions": spans, "tuplets": cooccur.window_tuplets(docs, self.window, self.extractor, self.boundary)}
        spans = written(extract.resolve_pronouns(spans, self.coref(docs)), "resolved")
        return {"mentions": spans, "tuplets": self._tuplets_of(docs, spans)}

    def _tuplets_of(self, docs: DataFrame, spans: DataFrame) -> DataFrame:
        """Window pairs of spans that are given as a table."""
        packed = docs.join(spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end", "span_text"))).alias("ends")), "doc_id", "left")
        base = packed.select("doc_id", F.coalesce("ends", F.array().cast(extract.SPANS)).alias("mentions"), tx.chunk_bounds("text", self.boundary).alias("chunks"))
        swept = base.select("doc_id", "chunks", tx.mentions_in_chunks().alias("swept"))
        return extract.exploded(swept.select("doc_id", tx.window_pairs(0 if self.window is None else self.window).alias("__pairs")), "__pairs", "one_start")

    def _labels(self) -> DataFrame:
        rows = self.tables["mentions"]
        if "is_coref_resolved" in rows.columns:
            rows = rows.filter("NOT coalesce(is_coref_resolved, false)")
        return written(self.mapper(rows.select(F.col("span_text").alias("label"))), "mapping")

    def _aggregate(self) -> None:
        t = self.tables
        self._mapping = labels = self._labels()
        mentions = mapping.apply(t["mentions"].withColumn("label", F.col("span_text")), labels, "label")
        tuplets = t["tuplets"].withColumn("a", F.col("one_text")).withColumn("b", F.col("two_text"))
        tuplets = mapping.apply(mapping.apply(tuplets, labels, "a"), labels, "b").withColumns({"one_label": F.col("a"), "two_label": F.col("b")})
        t["labelled_mentions"] = written(mentions, "labelled-mentions")
        t["labelled_tuplets"] = written(tuplets.withColumns({"entity_one": F.least("a", "b"), "entity_two": F.greatest("a", "b")}).drop("a", "b"), "labelled-tuplets")
        entities = stats.text_stats(t["labelled_mentions"], t["documents"], ["label"])
        t["entities"] = written(mapping.ranked_ids(entities, ["label"], "id"), "entities")
        pairs = stats.text_stats(t["labelled_tuplets"], t["documents"], ["entity_one", "entity_two"])
        t["cooccurrences"] = written(mapping.ranked_ids(stats.pmi(pairs, t["entities"]), ["entity_one", "entity_two"], "id"), "cooccurrences")
        t["entity_categories"] = written(self._with_id(stats.target_categories(t["labelled_mentions"], t["documents"], ["label"]), t["entities"], ["label"]), "entity-categories")
        t["cooccurrence_categories"] = written(self._with_id(stats.target_categories(t["labelled_tuplets"], t["documents"], ["entity_one", "entity_two"]), t["cooccurrences"], ["entity_one", "entity_two"]), "pair-categories")

    @staticmethod
    def _with_id(cats: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
        return cats.join(targets.select(*keys, "id"), keys).select("id", "name", "value")

    # persistence

    def save(self, path: str, overwrite: bool = False) -> str:
        """Write the tables and options; the model then reads what was saved, so it may be saved over itself."""
        path = store.save(self.tables, path, overwrite, self.options)
        self.tables = store.load(self.spark, path)
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options: Any) -> CooccurrenceModel:
        """A saved model with its options; those that are given here come first."""
        saved = {k: v for k, v in store.load_options(spark, path).items() if v is not None or k == "window"}
        return cls(spark, store.load(spark, path), **(saved | options))

    @classmethod
    def open(cls, spark: SparkSession, path: str, on_existing: str = "stop", **options: Any) -> CooccurrenceModel:
        tables = store.open_model(spark, path, on_existing)
        return cls.load(spark, path, **options) if tables else cls(spark, tables, **options)

    # tables

    @property
    def nodes(self) -> DataFrame:
        return self.tables["entities"]

    def connections(self, kind: str = "cooccurrence") -> DataFrame:
        if kind != "cooccurrence":
            raise ValueError(f"unknown connection type: {kind}")
        return self._ends(self.tables["cooccurrences"], "entity_one", "entity_two")

    def _ends(self, rows: DataFrame, one: str, two: str) -> DataFrame:
        ids = self.nodes.select("label", "id")
        rows = rows.join(ids.select(F.col("label").alias(one), F.col("id").alias("source")), one)
        return rows.join(ids.select(F.col("label").alias(two), F.col("id").alias("target")), two)

    def _pivot(self, kind: str) -> DataFrame | None:
        cats = self.tables[f"{kind}_categories"]
        names = [r["name"] for r in cats.select("name").distinct().orderBy("name").collect()]
        return stats.category_pivot(cats, ["id"], names) if names else None

    @property
    def _entity_alt(self) -> DataFrame:
        return stats.alt_labels(self.tables["labelled_mentions"], "label", "span_text")

    @property
    def entities(self) -> DataFrame:
        return lookup.export(self.nodes, ["id", "label"], self._entity_alt, self._pivot("entity"))

    @property
    def mentions(self) -> DataFrame:
        return lookup.mention_table(self.tables["labelled_mentions"], self.nodes)

    @property
    def cooccurrences(self) -> DataFrame:
        rows = lookup.with_frequencies(self.tables["cooccurrences"], self.nodes)
        rows = lookup.with_ends(rows, self.nodes, {"entity_one": "entity_one_id", "entity_two": "entity_two_id"})
        return lookup.export(rows, ["id"], pivot=self._pivot("cooccurrence"))

    @property
    def documents(self) -> DataFrame:
        return lookup.drop_empty_columns(lookup.document_categories(self.tables["documents"]))

    @property
    def tuplets(self) -> DataFrame:
        return lookup.tuplet_table(self.tables["labelled_tuplets"], self.nodes)

    def entity_details(self, ids: list[int] | None = None) -> DataFrame:
        return lookup.details(lookup.get_multiple(self.nodes, ids), self.tables["entity_categories"], self._entity_alt, stats.STATS)

    def cooccurrence_details(self, ids: list[int] | None = None) -> DataFrame:
        alt = self.tables["cooccurrences"].select("entity_one", "entity_two", F.array().cast("array<string>").alias("alt_labels"))
        return lookup.details(lookup.get_multiple(self.tables["cooccurrences"], ids), self.tables["cooccurrence_categories"], alt, (*stats.STATS, "pmi"))

    def document(self, doc_id: int) -> Any:
        """One document with its mentions and tuplets."""
        docs = lookup.with_annotations(self.tables["documents"].filter(F.col("doc_id") == doc_id), mentions=self._of(self.mentions, doc_id), tuplets=self._of(self.tuplets, doc_id))
        return lookup.get_single(docs, doc_id, "doc_id")

    @staticmethod
    def _of(rows: DataFrame, doc_id: int) -> DataFrame:
        return rows.filter(F.col("doc_id") == doc_id)

    def documents_of(self, ids: list[int], limit: int = 50, offset: int = 0) -> DataFrame:
        """A page of the documents that mention some entities, those of most of them first."""
        found = lookup.docs_by_focus(self.mentions, "entity_id", ids).join(self.tables["documents"], "doc_id")
        return lookup.page(found, [F.desc("n_matched"), "doc_id"], limit, offset)

    # queries

    def _relations(self, kind: str) -> tuple[DataFrame, DataFrame, bool]:
        return self.connections(kind), self.tables[f"{kind}_categories"], kind == "relation"

    def get_graph(self, kind: str = "cooccurrence", f: GraphFilter = GraphFilter()) -> tuple[DataFrame, DataFrame]:
        rows, cats, rel = self._relations(kind)
        return graph.top(self.nodes, rows, f, self.tables["entity_categories"], cats, rel)

    def get_subgraph(self, ids: list[int], kind: str = "cooccurrence", f: GraphFilter = GraphFilter()) -> tuple[DataFrame, DataFrame]:
        rows, cats, rel = self._relations(kind)
        return graph.subgraph(self.nodes, rows, ids, f, cats, rel)

    def expand(self, focus: list[int], kind: str = "cooccurrence", f: GraphFilter = GraphFilter()) -> tuple[DataFrame, DataFrame]:
        rows, cats, rel = self._relations(kind)
        return graph.expand(self.nodes, rows, focus, f, self.tables["entity_categories"], cats, rel)

    def find_communities(self, algorithm: str | Callable = "louvain", f: GraphFilter = GraphFilter(), weight: str = "pmi", min_weight: float = 0.0, **options: Any) -> tuple[DataFrame, DataFrame]:
        """(members, metrics)."""
        rows, cats, _ = self._relations("cooccurrence")
        v, e = community.community_graph(self.nodes, rows, f, weight, min_weight, self.tables["entity_categories"], cats)
        v, e = written(v, "vertices"), written(e, "edges")
        members = written(community.find(v, e, algorithm, **options), "communities")
        self._community_edges = e
        return members, community.metrics(members, e)

    def community_edges(self, members: DataFrame) -> DataFrame:
        """(community, edges): the edges inside each community that ``find_communities`` found last."""
        return community.inner_edges(members, self._community_edges)

    def get_contexts(self, ids: list[int]) -> DataFrame:
        """Merged contexts, with text, of the co-occurrences among some entities."""
        labels = [r["label"] for r in lookup.labels_by_ids(self.nodes, ids).collect()]
        rows = contexts.between_entities(self.tables["labelled_tuplets"], labels, "entity_one", "entity_two")
        return contexts.with_text(contexts.merged(rows.select("doc_id", "context_start", "context_end")), self.tables["documents"])

    def search(self, term: str, limit: int | None = None) -> DataFrame:
        return lookup.search(self.nodes, term, limit)

    def bounds(self, kind: str = "cooccurrence") -> DataFrame:
        return stats.bounds(self.tables["documents"], self.nodes, self.connections(kind))

    @property
    def connection_types(self) -> list[str]:
        return stats.connection_types(self.tables.get("relations"))


class NarrativeModel(CooccurrenceModel):
    """Also triplets: predicates and relations between entities."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, triplets: Callable[[DataFrame], DataFrame] = extract.leading_triplets, predicate_mapper: str | Callable = "subgram_lemmatization", **options: Any):
        super().__init__(spark, tables, **options)
        self.options["predicate_mapper"] = predicate_mapper if isinstance(predicate_mapper, str) else None
        self.triplet_extractor = triplets
        self.predicate_mapper = mapping.PRESETS[predicate_mapper] if isinstance(predicate_mapper, str) else predicate_mapper

    def _annotations(self, docs: DataFrame) -> dict[str, DataFrame]:
        found = written(self.triplet_extractor(docs), "triplets")
        # the entities are the ends of triplets; they also pair up in windows
        spans = extract.triplet_mentions(found)
        if self.coref is not None:
            spans = written(extract.resolve_pronouns(spans, self.coref(docs)), "resolved")
            text = spans.filter("is_coref_resolved").select("doc_id", "span_start", "span_end", "span_text")
            for r in ("subj", "obj"):
                keys = [F.col(c).alias(f"{r}_{c[5:]}" if c != "doc_id" else c) for c in ("doc_id", "span_start", "span_end")]
                kept = spans.select(*keys).distinct()
                found = found.join(kept, ["doc_id", f"{r}_start", f"{r}_end"], "left_semi").join(text.select(*keys, F.col("span_text").alias("__r")), ["doc_id", f"{r}_start", f"{r}_end"], "left")
                found = found.withColumn(f"{r}_text", F.coalesce("__r", f"{r}_text")).drop("__r")
        tuplets = self._tuplets_of(docs, spans)
        return {"triplets": found, "mentions": spans, "tuplets": tuplets}

    def _aggregate(self) -> None:
        super()._aggregate()
        t = self.tables
        labels = self._mapping
        predicates = written(self.predicate_mapper(t["triplets"].select(F.col("pred_text").alias("label"))), "predicate-mapping")
        rows = t["triplets"].withColumns({"subject": F.col("subj_text"), "predicate": F.col("pred_text"), "object": F.col("obj_text")})
        rows = mapping.apply(mapping.apply(rows, labels, "subject"), labels, "object")
        t["labelled_triplets"] = written(mapping.apply(rows, predicates, "predicate"), "labelled-triplets")
        p = stats.text_stats(t["labelled_triplets"], t["documents"], ["predicate"]).withColumnRenamed("predicate", "label")
        t["predicates"] = written(mapping.ranked_ids(p, ["label"], "id"), "predicates")
        cats = stats.target_categories(t["labelled_triplets"].select("doc_id", F.col("predicate").alias("label")), t["documents"], ["label"])
        t["predicate_categories"] = written(self._with_id(cats, t["predicates"], ["label"]), "predicate-categories")
        keys = ["subject", "predicate", "object"]
        r = stats.significance(stats.text_stats(t["labelled_triplets"], t["documents"], keys), t["predicates"])
        t["relations"] = written(mapping.ranked_ids(r, keys, "id"), "relations")
        t["relation_categories"] = written(self._with_id(stats.target_categories(t["labelled_triplets"], t["documents"], keys), t["relations"], keys), "relation-categories")

    def connections(self, kind: str = "relation") -> DataFrame:
        if kind != "relation":
            return super().connections(kind)
        return self._ends(self.tables["relations"], "subject", "object").withColumn("predicate_label", F.col("predicate"))

    @property
    def predicates(self) -> DataFrame:
        return lookup.export(self.tables["predicates"], ["id", "label"], self._predicate_alt, self._pivot("predicate"))

    @property
    def _predicate_alt(self) -> DataFrame:
        return stats.alt_labels(self.tables["labelled_triplets"], "predicate", "pred_text").withColumnRenamed("predicate", "label")

    @property
    def _relation_alt(self) -> DataFrame:
        other = self.tables["labelled_triplets"].filter("pred_text <> predicate")
        return other.groupBy("subject", "predicate", "object").agg(F.sort_array(F.collect_set("pred_text")).alias("alt_labels"))

    @property
    def relations(self) -> DataFrame:
        rows = lookup.with_frequencies(self.tables["relations"], self.nodes)
        rows = lookup.with_ends(rows, self.nodes, {"subject": "subject_entity_id", "object": "object_entity_id"})
        rows = lookup.with_ends(rows, self.tables["predicates"], {"predicate": "predicate_id"})
        rows = rows.join(self._relation_alt.withColumnRenamed("alt_labels", "alt_pred_labels"), ["subject", "predicate", "object"], "left")
        return lookup.export(rows, ["id"], pivot=self._pivot("relation"))

    @property
    def triplets(self) -> DataFrame:
        return lookup.triplet_table(self.tables["labelled_triplets"], self.nodes, self.tables["predicates"])

    def predicate_details(self, ids: list[int] | None = None) -> DataFrame:
        return lookup.details(lookup.get_multiple(self.tables["predicates"], ids), self.tables["predicate_categories"], self._predicate_alt, stats.STATS)

    def relation_details(self, ids: list[int] | None = None) -> DataFrame:
        rows = lookup.get_multiple(self.tables["relations"], ids)
        return lookup.details(rows, self.tables["relation_categories"], self._relation_alt, (*stats.STATS, "significance"))
