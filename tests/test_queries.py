"""Every registered query with a SQL twin gives its rows."""

import importlib
import math

import duckdb
import pytest

import __spark_entry__ as entry
from threadloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    run = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in run.fetchall()), key=repr)
    assert sorted((tuple(plain(x) for x in r) for r in got.select(*columns).collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_optional_operators(monkeypatch):
    import sys

    for m in [m for m in sys.modules if m.startswith("threadloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "threadloom.llm", None)
    again = importlib.reload(entry)
    assert set(again.queries()) == set(catalog.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_stemming_and_louvain_queries(spark):
    q = catalog.queries()
    stems = q["stem_map"](spark, FOLDER).collect()
    assert len({r["label"] for r in stems}) == len(stems)
    rows = q["louvain"](spark, FOLDER).collect()
    assert len({r["id"] for r in rows}) == len(rows)


def test_pairs_of_documents_are_whole(spark):
    q = catalog.queries()
    pairs = q["document_cooccurrences"](spark, FOLDER)
    assert pairs.filter("frequency = 1").count() > 0
    assert pairs.agg({"frequency": "sum"}).first()[0] == q["document_tuplets"](spark, FOLDER).count()
