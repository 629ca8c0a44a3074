"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Characters at the start of a text whose hash refines the groups of equal length.
PREFIX_CHARS = 64


def _keyed(docs: DataFrame, prefix_chars: int) -> tuple[DataFrame, F.Column]:
    """Bitmap of the (length, prefix hash) keys that several rows share, and the key."""
    size = F.octet_length("text")
    lengths = docs.filter("text IS NOT NULL").groupBy(size.alias("size")).count().filter("count > 1")
    of_length = shared.only_maybe(
        docs.filter("text IS NOT NULL").select("text"), shared.key_bits(lengths, F.col("size")), size
    )
    key = F.xxhash64(F.octet_length("text"), F.substring("text", 1, prefix_chars))
    groups = of_length.select(key.alias("key")).groupBy("key").count().filter("count > 1")
    return shared.key_bits(groups, F.col("key")), key


def duplicate_groups(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Every row whose text occurs more than once: (doc_id, kept_id, n_copies, n_bytes).

    Rows are grouped by byte length, the rows of shared lengths by a hash of their
    first characters, and only rows of shared prefixes have their full text
    hashed (SHA-256).  Between the steps only keys are shuffled, never texts, and
    a bitmap of fixed size tells the next scan which rows to read on.

    ``kept_id`` is the least doc_id of the group (nulls last, null if all are);
    ``n_copies`` counts rows.  Null texts are no copies of anything; empty texts
    are copies of one another; repeated rows are copies.  Other columns are ignored.
    """
    bits_df, key = _keyed(docs, prefix_chars)
    rows = shared.only_maybe(docs.filter("text IS NOT NULL").select("doc_id", "text"), bits_df, key).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest")
    )
    groups = (
        rows.groupBy("digest", "n_bytes").agg(F.min("doc_id").alias("kept_id"), F.count("*").alias("n_copies")).filter("n_copies > 1")
    )
    return rows.join(groups, ["digest", "n_bytes"]).select("doc_id", "kept_id", "n_copies", "n_bytes")


def drop_duplicates(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``docs`` with one row per distinct text, that of the least doc_id (nulls last).

    Rows whose (length, prefix) no other row shares pass without a shuffle.  Among
    the others the first row of each group is chosen by a partial aggregation in
    every task, so that a text with millions of copies never meets in one place.
    Rows with a null text all stay.  Among rows of one text and doc_id, which one
    stays is settled by the order of their other columns as JSON.
    """
    bits_df, key = _keyed(docs, prefix_chars)
    name = shared.unused(docs, "maybe")
    marked = shared.with_maybe(docs, bits_df, F.when(F.col("text").isNotNull(), key), name)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    sure = marked.filter(F.col("text").isNull() | ~F.col(name)).select(*columns)
    row = F.struct(*columns)
    first = (
        marked.filter(F.col("text").isNotNull() & F.col(name))
        .select(
            F.unhex(F.sha2("text", 256)).alias("__digest"),
            F.octet_length("text").alias("__size"),
            F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])).alias("rest")).alias("__order"),
            row.alias("__row"),
        )
        .groupBy("__digest", "__size")
        .agg(F.min_by("__row", "__order").alias("__row"))
    )
    return sure.unionByName(first.select("__row.*").select(*columns))
