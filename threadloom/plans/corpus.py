"""The corpora that the registered queries run on, from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cooccur, extract, stats
from ..sources.documents import category_map


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dated(docs: DataFrame) -> DataFrame:
    """Attributes that the documents lack, made from their ids."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(365)).cast("int"))
    return docs.withColumns({"timestamp": day, "timestamp_ordinal": F.col("doc_id").cast("int")})


#: Bytes of files up to which a table is spread; more make partitions enough by themselves.
SMALL_TABLE = 256 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores, if its files are few and SMALL_TABLE at most; large tables are read where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_TABLE
    return df.repartition(cores, key) if small and df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(spread(table(spark, sf_dir, "documents"), "doc_id"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their texts, which then needn't be read."""
    docs = dated(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"))
    return docs.withColumn("categories", category_map({"lang": F.array("lang"), "source": F.array("source")})).drop("lang", "source")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.mentions(documents(spark, sf_dir), keep=stats.DATES).withColumn("label", F.col("span_text"))


def tuplets(spark: SparkSession, sf_dir: str, window: int = 3) -> DataFrame:
    pairs = cooccur.window_tuplets(documents(spark, sf_dir), window, keep=stats.DATES)
    return pairs.withColumns({"entity_one": F.least("one_text", "two_text"), "entity_two": F.greatest("one_text", "two_text")})


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccur.mention_stats(documents(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccur.pair_stats(documents(spark, sf_dir))


def cooccurrences(spark: SparkSession, sf_dir: str, nodes: DataFrame | None = None, frequencies: bool = False) -> DataFrame:
    """With ``nodes`` from a table written before, the entities aren't counted again."""
    return stats.pmi(pairs(spark, sf_dir), entities(spark, sf_dir) if nodes is None else nodes, frequencies)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).withColumn("id", F.col("label"))


def as_edges(pairs: DataFrame) -> DataFrame:
    """Pairs as connections; they have pmi if the pairs do."""
    own = [c for c in (*stats.STATS, "pmi") if c in pairs.columns]
    return pairs.select(F.concat_ws("|", "entity_one", "entity_two").alias("id"), F.col("entity_one").alias("source"), F.col("entity_two").alias("target"), *own)


#: Rows of a table for each partition of what is made of it, where tasks would otherwise take the more memory the larger the table.
PART_ROWS = 500_000


def parts_for(df: DataFrame) -> int:
    """Partitions for a table, whose rows are counted: as many as the session's shuffles, or as PART_ROWS asks for."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PART_ROWS))


def star_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: market segment - return flag - brand, for every line.

    The rows of an order end up in one partition, as counts by order need them, and
    a partition has about as many rows at any size of the tables.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    n = parts_for(lines)
    lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).repartition(n, "l_orderkey")
    orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).repartition(n, "o_orderkey")
    dates = F.to_date("o_orderdate").alias("timestamp"), F.col("o_orderkey").cast("int").alias("timestamp_ordinal")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("l_orderkey").alias("doc_id"), *dates, F.col("c_mktsegment").alias("subject"), F.col("l_returnflag").alias("predicate"), F.col("p_brand").alias("object"))


def star_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("doc_id"), F.to_date("o_orderdate").alias("timestamp"), F.col("o_orderkey").cast("int").alias("timestamp_ordinal"),
        category_map({"priority": F.array("o_orderpriority"), "status": F.array("o_orderstatus")}).alias("categories"),
    )


def star_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, d = star_triplets(spark, sf_dir), star_documents(spark, sf_dir)
    predicates = stats.text_stats(t, d, ["predicate"]).withColumnRenamed("predicate", "label")
    return stats.significance(stats.text_stats(t, d, ["subject", "predicate", "object"]), predicates)


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = stats.union_columns(star_triplets(spark, sf_dir), ["subject", "object"], "label")
    return stats.text_stats(t, star_documents(spark, sf_dir), ["label"]).withColumn("id", F.col("label"))


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = star_relations(spark, sf_dir)
    return r.select(
        F.concat_ws("|", "subject", "predicate", "object").alias("id"), F.col("subject").alias("source"), F.col("object").alias("target"),
        F.col("predicate").alias("predicate_label"), *stats.STATS, "significance",
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return reduce(lambda d, c: d.withColumn(c, F.round(c, digits)), columns, df)
