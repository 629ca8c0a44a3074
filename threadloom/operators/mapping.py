"""Label normalisation and canonical labels."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lemma import lemma_column
from ..functions.porter2 import stem_column
from ..functions.text import determinerless, rank_key
from ..sources.scratch import written

Normalizer = Callable[[Column], Column]


def lower(label: Column) -> Column:
    return F.lower(label)


def stem(label: Column) -> Column:
    return stem_column(label)


def lemmatize(label: Column) -> Column:
    """Rule-based lemmas of all words, see ``functions.lemma``."""
    return lemma_column(label)


def fallback(*functions: Callable[[str], str]) -> Normalizer:
    """The first of several Python functions that doesn't raise; RuntimeError if all do."""

    @F.pandas_udf("string")
    def run(labels: pd.Series) -> pd.Series:
        def first(s: str | None) -> str | None:
            for f in functions if s is not None else ():
                try:
                    return f(s)
                except Exception:  # noqa: BLE001 - any failure passes to the next
                    continue
            if s is not None:
                raise RuntimeError("no normalizer works")
            return None

        return labels.map(first)

    return run


def identity(labels: DataFrame) -> DataFrame:
    return labels.select("label").distinct().select("label", F.col("label").alias("canonical"))


def normalized(labels: DataFrame, normalizer: Normalizer = lower, ranking: str = "shortest", drop_determiners: bool = True) -> DataFrame:
    """(label, canonical) of every distinct label of the column ``label``, whose repeats count.

    Labels of one normal form are a cluster; its canonical label is the shortest in
    words, then the most frequent (or, by ``most_frequent``, the other way round),
    then the one of the least code points, the longer of two that begin alike.
    Only distinct labels are normalised.
    """
    counts = labels.filter("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    bare = determinerless(F.col("label")) if drop_determiners else F.col("label")
    keyed = counts.withColumn("bare", bare).withColumn("norm", normalizer(F.col("bare")))
    best = keyed.groupBy("norm").agg(F.max_by("label", rank_key(F.col("label"), F.col("n"), ranking)).alias("canonical"))
    return keyed.join(best, "norm").select("label", "canonical")


def subgrams(labels: DataFrame, normalizer: Normalizer = lower, ranking: str = "shortest", min_length: int = 2, min_frequency: int = 10, ratio: float = 2.0, is_candidate: Column | None = None) -> DataFrame:
    """(label, canonical) after also mapping labels to frequent shorter labels that they contain.

    A candidate has at least ``min_length`` normalised words and ``min_frequency``
    occurrences, counted after the first mapping, and passes ``is_candidate`` (by
    default all do; give a condition on ``label`` to ask for a head word).  A label
    maps to the best candidate that is contained in it word by word and at least
    ``ratio`` times as frequent.  A candidate that others map to maps to itself, and
    mapping never goes on from there.

    Containment is an equality join of the labels' word n-grams with the candidates,
    not a comparison of all labels with all candidates.
    """
    first = normalized(labels, normalizer, ranking)
    mapped = labels.join(first, "label").groupBy(F.col("canonical").alias("label")).agg(F.count("*").alias("n"))
    keyed = mapped.withColumn("bare", determinerless(F.col("label"))).withColumn("norm", normalizer(F.col("bare"))).withColumn("w", F.split("norm", " "))
    good = (F.size("w") >= min_length) & (F.col("n") >= min_frequency)
    if is_candidate is not None:
        good = good & is_candidate
    candidates = keyed.filter(good).select(F.col("label").alias("main"), F.col("n").alias("main_n"), F.col("norm").alias("gram"))
    n_w = F.size("w")
    grams = keyed.filter(n_w >= min_length).select(
        "label", "n",
        F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(min_length), n_w), lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " ")))))).alias("gram"),
    )
    hits = grams.join(candidates, "gram").filter(F.col("main_n") >= ratio * F.col("n")) if ratio > 1 else grams.join(candidates, "gram").filter((F.col("main_n") >= ratio * F.col("n")) | (F.col("main") == F.col("label")))
    best = hits.filter("main <> label").groupBy("label").agg(F.max_by("main", rank_key(F.col("main"), F.col("main_n"), ranking)).alias("main"))
    mains = best.select("main").distinct()
    # a chosen candidate stays itself
    hop = best.join(mains.select(F.col("main").alias("label")), "label", "left_anti")
    return first.join(hop.select(F.col("label").alias("canonical"), "main"), "canonical", "left").select("label", F.coalesce("main", "canonical").alias("canonical"))


PRESETS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "identity": identity,
    "lower": normalized,
    "stemming": lambda labels: normalized(labels, stem),
    "subgram_lower": subgrams,
    "lemmatization": lambda labels: normalized(labels, lemmatize),
    "subgram_stemming": lambda labels: subgrams(labels, stem),
    "subgram_lemmatization": lambda labels: subgrams(labels, lemmatize),
}


def apply(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced by its canonical label; labels without one stay."""
    m = mapping.select(F.col("label").alias(column), F.col("canonical").alias("__canonical"))
    out = [F.coalesce("__canonical", column).alias(column) if c == column else F.col(c) for c in rows.columns]
    return rows.join(m, column, "left").select(*out)


def ranked_ids(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """``df`` with ids 1, 2, ... in the order of unique columns, without one task seeing all rows.

    The rows are range-partitioned and numbered in each partition; the partitions'
    sizes, one number each, give the offsets.
    """
    # written once: the borders of the ranges are sampled, so a second run could draw others
    parts = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    local = parts.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = local.join(F.broadcast(offsets.select("__part", "__before")), "__part")
    return joined.select(*df.columns, (F.col("__before") + F.col("__at")).alias(name))
