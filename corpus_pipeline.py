"""The training-data pipeline: each stage calls one operator and hands its documents on.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of ``documents``; the last returns the
windows of the packed corpus (see ``threadloom.llm.packing.pack``).  Columns beside
doc_id and text are passed on whatever their names and values; texts of any
length are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.llm import decontaminate, exact_dedup, jaccard_join, packing, shared, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the limit; the model is fitted on a bounded sample of labels.

    Null and empty texts have the severity of no features and stay; a severity at
    the limit is rejected; of repeated rows all stay or go.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, shared.table(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the least doc_id (null last).

    Null texts all stay; empty texts are copies of one another; rows that tie in
    doc_id are settled by their other columns, and of equal rows one stays.
    """
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, that of the least doc_id.

    Rows with a null id or text, or without a word, stay; a pair exactly at the
    threshold is one; rows of one doc_id stay or go together.
    """
    return jaccard_join.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Null and empty texts stay, as do all if the benchmark is empty; a coverage
    exactly at the limit is a passage; of repeated rows all stay or go.
    """
    return decontaminate.keep_clean(docs, shared.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The windows of all documents that are left.

    Null, empty and blank texts are in no window; rows without an id are packed
    with a null one; repeated rows are packed as often as they occur.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: SQL can express neither the fitted model nor the partitioning; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
