"""The pipeline against a brute-force version of every stage on a small corpus."""

import re

import numpy as np
import pytest

import corpus_pipeline
from threadloom.llm import shared, toxicity
from threadloom.llm.queries import oracle_sql, queries

from .test_operators import SCHEMA, grams, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    rows = [(i, prose(i, 40 + i % 30)) for i in range(120)]
    rows += [(200 + i, prose(400 + i, 40) + " idiot moron scum clown " * 3) for i in range(40)]
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, rows[4][1] + " extra words"), (303, rows[5][1] + " " + prose(9000, 20) + " " + prose(9100, 60)), (304, "")]
    rows += [(305, prose(9200, 50) + " " + prose(9000, 20)), (306, None)]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 200)) for i in [*range(0, 80), *range(200, 230)]], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, prose(9000, 20)), (2, prose(9999, 20))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), dict(rows)


def test_pipeline_against_brute_force(spark, folder):
    base, texts = folder
    docs = shared.table(spark, base, "documents")
    model = toxicity.train(docs, shared.table(spark, base, "labels"))
    toxic = {r["doc_id"] for r in toxicity.severity(docs, model).filter("toxic").collect()}
    assert toxic == {i for i, t in texts.items() if t and "idiot" in t}
    left = {i: t for i, t in texts.items() if i not in toxic}
    first = {}
    for i in sorted(left):
        if left[i] is not None:
            first.setdefault(left[i], i)
    left = {i: t for i, t in left.items() if t is None or first[t] == i}
    root = {i: i for i in left}

    def find(x):
        return x if root[x] == x else find(root[x])

    ids = [i for i in left if left[i] and grams(left[i])]
    for a in ids:
        for b in ids:
            if a < b and len(grams(left[a]) & grams(left[b])) >= 0.5 * len(grams(left[a]) | grams(left[b])):
                root[max(find(a), find(b))] = min(find(a), find(b))
    left = {i: t for i, t in left.items() if find(i) == i}
    left = {i: t for i, t in left.items() if not t or prose(9000, 20) not in t}
    out = corpus_pipeline.run(spark, base).collect()
    assert {r["doc_id"] for r in out} == {i for i, t in left.items() if t and t.split()}
    assert sum(r["n_words"] for r in out) == sum(len(t.split()) for t in left.values() if t)
    assert {300, 301, 302, 303, 305}.isdisjoint(r["doc_id"] for r in out)


def test_stages_hand_on_the_columns_of_documents(spark, folder):
    docs = shared.table(spark, folder[0], "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns, name


def test_stages_take_an_empty_table(spark, folder):
    docs = shared.table(spark, folder[0], "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).count() == 0


def test_every_operator_has_one_query():
    names = [re.match(r"op(\d+)_", q) for q in queries()]
    assert sorted(int(m[1]) for m in names) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())


def test_shared_folder_is_refused_on_a_cluster_without_the_setting():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Gone:
        def getOrElse(self, default):
            return default

    class Java:
        def sc(self):
            return self

        def getCheckpointDir(self):
            return Gone()

    Context._jsc = Java()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        shared.shared_dir(Session())


def test_bitmap_never_loses_a_key(spark):
    ids = spark.range(0, 5000).withColumnRenamed("id", "doc_id")
    docs = spark.range(0, 20000).withColumnRenamed("id", "doc_id")
    kept = shared.without_ids(docs, ids.filter("doc_id % 3 = 0"))
    want = [i for i in range(20000) if not (i < 5000 and i % 3 == 0)]
    assert np.array_equal(np.sort(kept.toPandas()["doc_id"].to_numpy()), want)
