"""Analyses of a finished model: distributions, heat maps, community comparisons and typologies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mention_frequencies(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy("span_text").agg(F.count("*").alias("frequency"))


def hapaxes(entities: DataFrame) -> DataFrame:
    """Entities that are mentioned once."""
    return entities.filter("frequency = 1")


#: Ranks in one run.
RANKS = 10_000


def zipf(frequencies: DataFrame, name: str = "span_text") -> DataFrame:
    """(slope, intercept, n): least squares of ln(frequency) on ln(rank), ranks by frequency and then name.

    The rank of a row is the number of rows of higher frequencies plus its place
    among its equals, so no task orders all rows: the window over frequencies has
    one row for each distinct value.
    """
    sizes = frequencies.groupBy("frequency").agg(F.count("*").alias("k"))
    before = sizes.withColumn("above", F.coalesce(F.sum("k").over(Window.orderBy(F.desc("frequency")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the ranks of equals are above + 1 .. above + k, in runs that tasks share, so that no array or task holds all hapaxes
    last = F.col("above") + F.col("k")
    runs = before.select("frequency", last.alias("last"), F.explode(F.sequence(F.col("above") + 1, last, F.lit(RANKS))).alias("start")).repartition("start")
    points = runs.select(F.ln("frequency").alias("y"), F.explode(F.sequence("start", F.least(F.col("start") + RANKS - 1, F.col("last")))).alias("rank"))
    x = F.ln("rank")
    return points.select("y", x.alias("x")).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count("*").alias("n"))


def pmi_heatmap(cooccurrences: DataFrame) -> DataFrame:
    """(bin_one, bin_two, avg_pmi, n): mean PMI by the entities' frequencies in bins (0,1], (1,2], (2,4], ..., both ways round."""
    one = cooccurrences.select(F.col("entity_one_frequency").alias("f1"), F.col("entity_two_frequency").alias("f2"), "pmi")
    both = one.unionByName(one.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "pmi"))
    cell = [F.ceil(F.log2(c)).cast("int").alias(n) for c, n in (("f1", "bin_one"), ("f2", "bin_two"))]
    return both.select(*cell, "pmi").groupBy("bin_one", "bin_two").agg(F.avg("pmi").alias("avg_pmi"), F.count("*").alias("n"))


def without_giants(sizes: list[int], factor: float = 2.0, most: int = 100) -> list[int]:
    """Community sizes, ascending, up to the first that is over ``most`` or more than ``factor`` times the last."""
    out: list[int] = []
    for s in sorted(sizes):
        if s > most or (out and s > factor * out[-1]):
            break
        out.append(s)
    return out


def size_summary(members: DataFrame) -> DataFrame:
    """One row: number, mean, least, quartiles and greatest of the community sizes, and memberships per entity."""
    sizes = members.groupBy("community").agg(F.count("*").alias("n"))
    per_entity = members.groupBy("id").agg(F.count("*").alias("k")).agg(F.avg("k").alias("memberships"))
    stats = sizes.agg(
        F.count("*").alias("communities"), F.avg("n").alias("mean_size"), F.min("n").alias("min_size"),
        F.percentile("n", 0.25).alias("q1_size"), F.percentile("n", 0.5).alias("median_size"), F.percentile("n", 0.75).alias("q3_size"), F.max("n").alias("max_size"),
    )
    return stats.crossJoin(per_entity)


def best_overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(community, n, coverage): for each community of ``a`` the greatest share of it that one of ``b`` holds."""
    size = a.groupBy("community").agg(F.count("*").alias("n"))
    shared = a.join(b.select(F.col("community").alias("other"), "id"), "id").groupBy("community", "other").agg(F.count("*").alias("k"))
    best = shared.groupBy("community").agg(F.max("k").alias("k"))
    return size.join(best, "community", "left").select("community", "n", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("coverage"))


def coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """(coverage): mean of the best overlaps, weighted by size."""
    return best_overlaps(a, b).agg((F.sum(F.col("coverage") * F.col("n")) / F.sum("n")).alias("coverage"))


def spikes(members: DataFrame, tuplets: DataFrame, docs: DataFrame) -> DataFrame:
    """(community, spikes, spread): documents in which members of a community co-occur, and the days that they span."""
    one, two = members.select(F.col("id").alias("entity_one"), "community"), members.select(F.col("id").alias("entity_two"), "community")
    hits = tuplets.select("doc_id", "entity_one", "entity_two").join(one, "entity_one").join(two, ["entity_two", "community"])
    seen = hits.select("community", "doc_id").distinct().join(docs.select("doc_id", "timestamp"), "doc_id")
    return seen.groupBy("community").agg(F.count("*").alias("spikes"), (F.datediff(F.max("timestamp"), F.min("timestamp")) + 1).alias("spread"))


def spike_heatmap(found: DataFrame) -> DataFrame:
    """(spread_bin, spike_bin, n) of communities of several spikes, by powers of 10 and of 2."""
    return found.filter("spikes > 1").groupBy(F.floor(F.log10("spread")).cast("int").alias("spread_bin"), F.floor(F.log2("spikes")).cast("int").alias("spike_bin")).agg(F.count("*").alias("n"))


#: (name, least spread, spread below, least spikes, spikes below); None is open.
TYPES = (
    ("single", None, None, None, 2), ("burst", None, 8, 2, None), ("short", 8, 31, 2, 8), ("short_dense", 8, 31, 8, None),
    ("long", 31, 366, 2, 8), ("long_dense", 31, 366, 8, None), ("perennial", 366, None, 2, None),
)


def typology(found: DataFrame, types: tuple = TYPES) -> DataFrame:
    """(community, spikes, spread, type): the first cell of the table that holds a community."""
    kind = F.lit(None).cast("string")
    for name, a, b, c, d in reversed(types):
        cond = F.lit(True)
        for bound, test in ((a, lambda v: F.col("spread") >= v), (b, lambda v: F.col("spread") < v), (c, lambda v: F.col("spikes") >= v), (d, lambda v: F.col("spikes") < v)):
            if bound is not None:
                cond = cond & test(bound)
        kind = F.when(cond, name).otherwise(kind)
    return found.withColumn("type", kind)


def compare_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, frequency_a, frequency_b, change, side): the entities of two models side by side, 0 where one lacks them."""
    x, y = a.select("label", F.col("frequency").alias("frequency_a")), b.select("label", F.col("frequency").alias("frequency_b"))
    both = x.join(y, "label", "full").fillna(0, ["frequency_a", "frequency_b"])
    side = F.when(F.col("frequency_b") == 0, "only_a").when(F.col("frequency_a") == 0, "only_b").otherwise("shared")
    return both.select("label", "frequency_a", "frequency_b", (F.col("frequency_b") - F.col("frequency_a")).alias("change"), side.alias("side"))


def comparison_summary(compared: DataFrame) -> DataFrame:
    """(side, n, hapaxes_a, hapaxes_b)."""
    return compared.groupBy("side").agg(F.count("*").alias("n"), F.count(F.when(F.col("frequency_a") == 1, 1)).alias("hapaxes_a"), F.count(F.when(F.col("frequency_b") == 1, 1)).alias("hapaxes_b"))


def edge_width(total_frequency):
    return F.log10(F.coalesce(F.nullif(total_frequency, F.lit(0)), F.lit(10)))
