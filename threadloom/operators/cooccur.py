"""Co-occurrence: pairs of mentions that stand near one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sweep
from ..functions import text as tx
from . import stats
from .extract import SPANS, Extractor, capitalized, mapped
from .extract import mentions as extract_mentions


def _sources(docs: DataFrame, extractor: Extractor, boundary: str, keep: list[str]) -> DataFrame:
    """``keep`` and what mentions and chunks are found in: the texts, or spans that an extractor or pattern of one's own makes."""
    own = {} if extractor is capitalized else {"__spans": F.coalesce(extractor(), F.array().cast(SPANS))}
    own |= {} if boundary == tx.BOUNDARY else {"__bounds": tx.chunk_bounds("text", boundary)}
    return docs.select(*keep, *["text"] * (len(own) < 2), *[c.alias(name) for name, c in own.items()])


def placed_mentions(docs: DataFrame, extractor: Extractor = capitalized, boundary: str = tx.BOUNDARY) -> DataFrame:
    """(doc_id, chunk, span_start, span_end, span_text) of the mentions fully inside a chunk; a map."""
    base = _sources(docs, extractor, boundary, ["doc_id"])
    return mapped(base, sweep.placed_rows(["doc_id"]), ["doc_id"], "chunk int, span_start int, span_end int, span_text string")


def window_tuplets(docs: DataFrame, window: int | None = 3, extractor: Extractor = capitalized, boundary: str = tx.BOUNDARY, keep: tuple[str, ...] = (), ids: DataFrame | None = None) -> DataFrame:
    """Pairs within a chunk and with the next ``window`` chunks, with their context.

    ``keep`` names columns of the documents to carry along.  ``ids`` (label, id) adds
    entity_one_id and entity_two_id: they are joined with the labels of each
    document, which are far fewer than its pairs.

    (doc_id, one_start, one_end, one_text, two_start, two_end, two_text, context_start,
    context_end), the first mention of the text first.  None pairs within chunks only.

    The whole operator is a map: each mention meets a range of the later ones, whose
    end is known from their chunks, so the work is in proportion to the pairs, of
    which a bounded number is held at a time.
    """
    kept = ["doc_id", *keep]
    base, added = _sources(docs, extractor, boundary, kept), ""
    if ids is not None:
        labels = extract_mentions(docs, extractor).select("doc_id", F.col("span_text").alias("label")).distinct()
        known = labels.join(ids.select("label", "id"), "label").groupBy("doc_id").agg(F.collect_list(F.struct("label", "id")).alias("__ids"))
        base, added = base.join(known, "doc_id"), f"entity_one_id {dict(ids.dtypes)['id']}, entity_two_id {dict(ids.dtypes)['id']}, "
    return mapped(base, sweep.tuplet_rows(_checked(window), kept, ids is not None), kept, added + "one_start int, one_end int, one_text string, two_start int, two_end int, two_text string, context_start int, context_end int")


def _checked(window: int | None) -> int:
    window = 0 if window is None else window
    if window < 0:
        raise ValueError("window must not be negative")
    return window


def pair_stats(docs: DataFrame, window: int | None = 3, extractor: Extractor = capitalized, boundary: str = tx.BOUNDARY) -> DataFrame:
    """(entity_one, entity_two) + STATS: ``stats.text_stats`` of the pairs that ``window_tuplets`` gives, without making them as rows.

    Every document must be one row (doc_id, text, timestamp, timestamp_ordinal).
    """
    return _stats(docs, _checked(window), ["entity_one", "entity_two"], extractor, boundary)


def mention_stats(docs: DataFrame, extractor: Extractor = capitalized) -> DataFrame:
    """(label) + STATS: ``stats.text_stats`` of the documents' mentions, likewise."""
    return _stats(docs, None, ["label"], extractor)


def document_cooccurrences(docs: DataFrame, extractor: Extractor = capitalized) -> DataFrame:
    """(entity_one, entity_two, frequency) of all pairs of mentions of a document, whose labels are counted before they pair up."""
    base = _sources(docs, extractor, tx.BOUNDARY, [])
    found = base.mapInArrow(sweep.document_pair_rows(), "entity_one string, entity_two string, n long")
    # summed up by parts already: once more before the shuffle would hold nearly every row for nothing
    return found.repartition("entity_one", "entity_two").groupBy("entity_one", "entity_two").agg(F.sum("n").alias("frequency"))


def ordered_cooccurrences(rows: DataFrame, parts: int) -> DataFrame:
    """(entity_one, entity_two, frequency, doc_frequency) of the pairs of rows (doc_id, at, label) of one document with different places.

    Labels are whole numbers.  Documents are sorted in each of ``parts`` partitions and
    paired up as arrays, so their pairs are never held by document; nearly all may
    be different, so none are summed up before the shuffle beyond a batch.
    """
    kind = dict(rows.dtypes)["label"]
    near = rows.select("doc_id", "at", F.col("label").cast("long").alias("label")).repartition(parts, "doc_id").sortWithinPartitions("doc_id")
    found = near.mapInArrow(sweep.ordered_pair_rows(), "one long, two long, n long, docs long").repartition(parts, "one", "two")
    summed = found.groupBy("one", "two").agg(F.sum("n").alias("frequency"), F.sum("docs").alias("doc_frequency"))
    return summed.select(F.col("one").cast(kind).alias("entity_one"), F.col("two").cast(kind).alias("entity_two"), "frequency", "doc_frequency")


def _stats(docs: DataFrame, window: int | None, keys: list[str], extractor: Extractor, boundary: str = tx.BOUNDARY) -> DataFrame:
    base = _sources(docs, extractor, boundary, list(stats.DATES))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"{k} string" for k in keys], "n long, docs long", *[f"{a}{i} {kinds[c]}" for a, c in zip("to", stats.DATES) for i in (0, 1)]])
    found = base.mapInArrow(sweep.stat_rows(window, keys), schema).groupBy(*keys).agg(
        F.sum("n").alias("frequency"), F.sum("docs").alias("doc_frequency"), F.min("t0").alias("first_occurrence"), F.max("t1").alias("last_occurrence"),
        F.min("o0").alias("first_occurrence_ordinal"), F.max("o1").alias("last_occurrence_ordinal"),
    )
    return stats.with_tf_idf(found, docs, keys)


def document_tuplets(mentions: DataFrame) -> DataFrame:
    """All pairs of mentions of a document, without a context.

    Quadratic in the mentions of a document, which is inherent.  A join on the
    document streams the pairs, and adaptive execution splits documents of very many mentions.
    """
    m = mentions.select("doc_id", "span_start", "span_end", "span_text")
    one = m.select("doc_id", *[F.col(f"span_{c}").alias(f"one_{c}") for c in ("start", "end", "text")])
    two = m.select("doc_id", *[F.col(f"span_{c}").alias(f"two_{c}") for c in ("start", "end", "text")])
    after = (F.col("two_start") > F.col("one_start")) | ((F.col("two_start") == F.col("one_start")) & (F.struct("two_end", "two_text") > F.struct("one_end", "one_text")))
    pairs = one.join(two, "doc_id").filter(after)
    return pairs.withColumns({"context_start": F.lit(None).cast("int"), "context_end": F.lit(None).cast("int")})


def unordered(one: str = "entity_one", two: str = "entity_two") -> list[Column]:
    return [F.least(one, two).alias("entity_one"), F.greatest(one, two).alias("entity_two")]
