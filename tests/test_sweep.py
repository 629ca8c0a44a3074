"""Mentions, chunks and pairs by vectors give what the column expressions and plain aggregations give."""

import time

import pytest
from pyspark.sql import functions as F

from threadloom.functions import sweep
from threadloom.functions import text as tx
from threadloom.operators import cooccur, extract, lookup, mapping, stats

TEXTS = ["Alice met Bob. Carol left.\n\nDave saw ...Alice! ", " Eve,\tAlice? ..! \n Bob A.B", "", None, "x.", " y Bob", "Bob Bob Bob Élan \U0001f600 Zoë;", "?!", "\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i * 3 % 7 if i % 4 else None) for i, t in enumerate(TEXTS, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, timestamp_ordinal int")
    return df.withColumn("timestamp", F.date_add(F.lit("2024-01-01").cast("date"), F.col("timestamp_ordinal")))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or sorted(df.columns)).collect()), key=repr)


def test_mentions_and_chunks_are_those_of_the_expressions(docs):
    want = docs.select("doc_id", F.inline(tx.capitalized_mentions("text")))
    assert rows(extract.mentions(docs)) == rows(want)
    want = docs.select("doc_id", F.posexplode(tx.chunk_bounds("text")).alias("chunk", "c")).select("doc_id", "chunk", "c.*")
    assert rows(extract.chunks(docs)) == rows(want)


@pytest.mark.parametrize("window", [0, 1, 3])
def test_pairs_are_those_of_the_expressions(docs, window):
    base = docs.select("doc_id", extract.capitalized().alias("mentions"), tx.chunk_bounds("text").alias("chunks")).select("doc_id", "chunks", tx.mentions_in_chunks().alias("swept"))
    want = base.select("doc_id", F.inline(tx.window_pairs(window)))
    assert rows(cooccur.window_tuplets(docs, window)) == rows(want)
    by_columns = cooccur.window_tuplets(docs, window, lambda: tx.capitalized_mentions("text"), "(?:" + tx.BOUNDARY + ")")
    assert rows(by_columns) == rows(want)


def test_statistics_are_those_of_the_rows(docs):
    pairs = cooccur.window_tuplets(docs, 3).withColumns({"entity_one": F.least("one_text", "two_text"), "entity_two": F.greatest("one_text", "two_text")})
    assert rows(cooccur.pair_stats(docs)) == rows(stats.text_stats(pairs, docs, ["entity_one", "entity_two"]))
    labels = extract.mentions(docs).withColumn("label", F.col("span_text"))
    assert rows(cooccur.mention_stats(docs)) == rows(stats.text_stats(labels, docs, ["label"]))
    all_pairs = cooccur.document_tuplets(extract.mentions(docs)).select(*cooccur.unordered("one_text", "two_text")).groupBy("entity_one", "entity_two").agg(F.count("*").alias("frequency"))
    assert rows(cooccur.document_cooccurrences(docs)) == rows(all_pairs)


def test_ids_come_with_the_pairs(docs):
    nodes = mapping.ranked_ids(extract.mentions(docs).select(F.col("span_text").alias("label")).distinct(), ["label"])
    named = {"one_label": F.col("one_text"), "two_label": F.col("two_text")}
    want = lookup.tuplet_table(cooccur.window_tuplets(docs).withColumns(named), nodes)
    assert rows(lookup.tuplet_table(cooccur.window_tuplets(docs, ids=nodes).withColumns(named))) == rows(want)


def test_pairs_of_one_long_chunk_are_counted_in_parts(spark):
    n = 4000
    df = spark.createDataFrame([(1, " ".join(f"N{i % 50:02d}" for i in range(n)))], "doc_id long, text string").withColumns({"timestamp": F.lit("2024-01-01").cast("date"), "timestamp_ordinal": F.lit(1)})
    began = time.time()
    assert cooccur.pair_stats(df).agg(F.sum("frequency"), F.count("*")).first() == (n * (n - 1) // 2, 50 * 51 // 2)
    assert time.time() - began < 20  # rows of pairs took minutes, as one array of eight million structs


def test_parts_of_a_batch_add_up(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"timestamp": pa.array([1, 2, 3], pa.int32()).cast(pa.date32()), "timestamp_ordinal": pa.array([5, None, 4], pa.int32()), "text": ["A B. C", "B A", "A\nB"]})
    want = list(sweep.stat_rows(3, ["one", "two"])(iter([batch])))
    monkeypatch.setattr(sweep, "PAIRS", 1)
    monkeypatch.setattr(sweep, "SLICE_BYTES", 1)
    got = list(sweep.stat_rows(3, ["one", "two"])(iter([batch])))
    assert pa.Table.from_batches(got).to_pydict() == pa.Table.from_batches(want).to_pydict()
    assert pa.Table.from_batches(want).to_pylist()[0] == {"one": "A", "two": "B", "n": 3, "docs": 3, "t0": want[0]["t0"][0].as_py(), "t1": want[0]["t1"][0].as_py(), "o0": 4, "o1": 5}


def test_louvain_of_arrays_is_about_as_good(spark):
    import random

    import numpy as np

    from threadloom.operators import community

    rng = random.Random(5)
    pairs = sorted({(min(i, j), max(i, j)) for i in range(300) for j in range(300) if i != j and rng.random() < (0.4 if i // 30 == j // 30 else 0.01)})
    a, b = (np.array(x, dtype=np.int32) for x in zip(*pairs))
    rows = [(*p, 1.0) for p in pairs] + [(0, 0, 1.0)]
    member = community.louvain_of_arrays(np.append(a, 0), np.append(b, 0), np.ones(len(rows)), 300)
    assert all(member[member] == member) and all(member <= np.arange(300)) and len(set(member.tolist())) == 10
    alone = community.louvain_partition(rows)
    assert len({(alone[i], int(member[i])) for i in range(300)}) == 10  # the same communities
    # by Spark, with names in place of numbers, and two components of which one is beyond one task
    edges = spark.createDataFrame([(f"v{x:03d}", f"v{y:03d}", w) for x, y, w in rows] + [("y", "z", 1.0)], "a string, b string, weight double")
    vertices = spark.createDataFrame([(f"v{i:03d}",) for i in range(300)] + [("x",), ("y",), ("z",)], "id string")
    found = {r["id"]: r["community"] for r in community.louvain(vertices, edges, 1.0, one_task=10).collect()}
    assert found == {f"v{i:03d}": f"v{member[i]:03d}" for i in range(300)} | {"x": "x", "y": "y", "z": "y"}


def test_pairs_of_orders(spark, monkeypatch):
    import pyarrow as pa

    lines = [(1, 1, 5), (1, 2, 5), (1, 3, 4), (2, 1, 4), (2, 2, 5), (2, 2, 9), (3, 1, 5)]
    df = spark.createDataFrame(lines, "doc_id long, at int, label int")
    want = [(4, 5, 3, 2), (4, 9, 1, 1), (5, 5, 1, 1)]
    assert rows(cooccur.ordered_cooccurrences(df, 3), "entity_one", "entity_two", "frequency", "doc_frequency") == want
    assert dict(cooccur.ordered_cooccurrences(df, 3).dtypes)["entity_one"] == "int"
    # documents that go on in the next batch
    monkeypatch.setattr(sweep, "PAIRS", 1)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [x[0]], "at": [x[1]], "label": [x[2]]}) for x in lines]
    got = [tuple(r.values()) for b in sweep.ordered_pair_rows()(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == [(4, 5, 1, 1), (4, 5, 2, 1), (4, 9, 1, 1), (5, 5, 1, 1)]


def test_partitions_follow_the_rows_of_a_table(spark, monkeypatch):
    from threadloom.plans import corpus

    monkeypatch.setattr(corpus, "PART_ROWS", 500)
    t = corpus.star_triplets(spark, "/root/testdata/sf0.001")
    assert t.rdd.getNumPartitions() >= 12  # some 6,000 lines; they were as many as the session's shuffles before
    assert t.select("doc_id", F.spark_partition_id().alias("p")).distinct().groupBy("doc_id").count().filter("count > 1").isEmpty()


def test_runs_of_words(spark, monkeypatch):
    import random
    from collections import Counter

    rng = random.Random(3)
    lists = [[rng.choice("abcde") * rng.randint(1, 2) for _ in range(n)] for n in (0, 1, 2, 3, 40, 300)] + [None]
    texts = spark.createDataFrame([(x,) for x in lists], "words array<string>")
    for n in (1, 2, 3):
        want = Counter(tuple(x[i : i + n]) for x in lists if x for i in range(len(x) - n + 1))
        got = extract.word_runs(texts, n).groupBy(*"abc"[:n]).agg(F.sum("n").alias("n"))
        assert {tuple(r)[:-1]: r["n"] for r in got.collect()} == want
    threes = spark.createDataFrame([(" ".join(x),) for x in {tuple(x[i : i + 3]) for x in lists if x for i in range(len(x) - 2)}], "phrase string")
    want = rows(extract.good_phrases(threes, texts, 5, 0.0))
    assert 0 < len(want) < threes.count() and rows(extract.good_threes(texts, 5, 0.0)) == want


def test_words_are_runs_of_letters():
    texts = ["Ab1c-\u00e9d \u212aelvin \u0130x", "", "a", "A.b", " "]
    words, sizes = sweep.letter_words(texts)
    import re

    want = [re.findall("[a-z]+", t.lower()) for t in texts]
    assert words.to_pylist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
    assert sweep.letter_words(["", ""])[1].tolist() == [0, 0]


def test_one_text_of_very_many_words(spark):
    text = " ".join("abcdefghij"[i % 7] + "xyz"[i % 3] for i in range(300_000))
    began = time.time()
    assert extract.good_threes(spark.createDataFrame([(text,)], "text string")).count() == 21
    assert time.time() - began < 30
