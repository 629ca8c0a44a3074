"""Helpers of this subpackage: tables, and key filters of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.corpus import spread
from ..sources.scratch import new_path, shared_dir, written

__all__ = ["key_bits", "new_path", "only_ids", "only_maybe", "shared_dir", "table", "unused", "with_maybe", "without_ids", "written"]

#: Slots of the bitmaps that pre-filter scans; this bounds what is broadcast.
FILTER_BITS = 26
#: Keys of a bitmap beyond which too many slots would be set for it to filter.
FILTER_KEYS = 1 << (FILTER_BITS - 2)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; small ones with texts, whose few files would be few tasks, are spread over all cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    key = {"documents": "doc_id", "pages": "page_id"}.get(name)
    return spread(df, key) if key else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column has it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def key_bits(keys: DataFrame, key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """A bitmap of hashed keys as rows (word, mask): at most 2**(bits - 6) rows.

    It holds every key and, by chance, some that were not given; what passes it
    must be checked exactly afterwards.  Its size is fixed by ``bits``, so it can
    be broadcast at any size of ``keys``.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    return (
        keys.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("bit_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS INT)))").alias("bit_mask"))
    )


def with_maybe(df: DataFrame, bits_df: DataFrame, key: Column, name: str, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with the boolean column ``name``, which it must not have: False only where the key is not in the bitmap."""
    at = unused(df, "slot_of_key")
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    rows = df.withColumn(at, F.struct(F.shiftright(slot, 6).alias("w"), slot.bitwiseAND(F.lit(63)).cast("int").alias("b"))).alias("r")
    joined = rows.join(F.broadcast(bits_df).alias("b"), F.col(f"r.{at}.w") == F.col("b.bit_word"), "left")
    hit = F.expr(f"coalesce(shiftrightunsigned(b.bit_mask, r.{at}.b) & 1L, 0L) = 1L")
    return joined.select(*(F.col(f"r.`{c}`") for c in df.columns), hit.alias(name))


def only_maybe(df: DataFrame, bits_df: DataFrame, key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``df`` whose key may be in the bitmap, without a shuffle."""
    name = unused(df, "maybe")
    return with_maybe(df, bits_df, key, name, bits).filter(F.col(name)).drop(name)


def only_ids(docs: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``, and possibly some others, which the caller must bear.

    The rows pass a bitmap where they stand; for more ids than a bitmap tells
    apart, they are joined.
    """
    if n_ids > FILTER_KEYS:
        return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
    return only_maybe(docs, key_bits(ids, F.col("doc_id")), F.col("doc_id"))


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the doc_ids of ``ids``; rows with a null doc_id stay.

    Only rows that pass the bitmap of the dropped ids are shuffled.
    """
    bits_df = key_bits(ids, F.col("doc_id"))
    name = unused(docs, "maybe")
    marked = with_maybe(docs, bits_df, F.col("doc_id"), name)
    sure = marked.filter(~F.col(name)).drop(name)
    rest = marked.filter(F.col(name)).drop(name).join(ids.select("doc_id").distinct(), "doc_id", "left_anti")
    return sure.unionByName(rest.select(*(F.col(f"`{c}`") for c in docs.columns)))
