"""The worked example, lifecycle and queries of the models."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadloom.model import CooccurrenceModel, NarrativeModel
from threadloom.operators import contexts, graph, lookup
from threadloom.operators.filters import GraphFilter
from threadloom.sources import documents, store
from threadloom.streaming import incremental

TEXTS = ["Alice met Bob. Carol left.", "Bob saw Alice.", "Carol saw Bob. Alice slept. Dave ran."]
LISTS = {"timestamps": [dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 3, 1)], "timestamps_ordinal": [1, 2, 3], "categories": [["A"], ["B"], ["A", "B"]]}


@pytest.fixture(scope="module")
def model(spark):
    return CooccurrenceModel(spark, window=3).fit(TEXTS, **LISTS)


def test_entities(model):
    got = {r["label"]: (r["frequency"], r["doc_frequency"], r["adjusted_tf_idf"], str(r["first_occurrence"]), r["category"]) for r in model.entities.collect()}
    assert got == {
        "Alice": (3, 3, 1.5, "2024-01-01", ["A", "B"]), "Bob": (3, 3, 1.5, "2024-01-01", ["A", "B"]),
        "Carol": (2, 2, 1.0, "2024-01-01", ["A", "B"]), "Dave": (1, 1, 0.0, "2024-03-01", ["A", "B"]),
    }


@pytest.mark.parametrize(
    ("window", "want"),
    [
        (0, {("Alice", "Bob"): (2, 0.30103), ("Bob", "Carol"): (1, 0.176091)}),
        (None, {("Alice", "Bob"): (2, 0.30103), ("Bob", "Carol"): (1, 0.176091)}),
        (1, {("Alice", "Bob"): (3, 0.477121), ("Alice", "Carol"): (2, 0.477121), ("Alice", "Dave"): (1, 0.477121), ("Bob", "Carol"): (2, 0.477121)}),
    ],
)
def test_windows(spark, window, want):
    m = CooccurrenceModel(spark, window=window).fit(TEXTS)
    assert {(r["entity_one"], r["entity_two"]): (r["frequency"], round(r["pmi"], 6)) for r in m.cooccurrences.collect()} == want


def test_contexts_of_window_one(spark):
    m = CooccurrenceModel(spark, window=1).fit(TEXTS)
    got = {(r["doc_id"], r["context_start"], r["context"]) for r in m.get_contexts([1, 2, 4]).collect()}
    assert got == {(1, 0, "Alice met Bob. Carol left"), (2, 0, "Bob saw Alice"), (3, 0, "Carol saw Bob. Alice slept. Dave ran")}
    with pytest.raises(ValueError):
        CooccurrenceModel(spark, window=-1).fit(TEXTS)


def labels(nodes):
    return sorted(r["label"] for r in nodes.collect())


def test_graph_queries(model):
    nodes, edges = model.get_graph(f=GraphFilter(limit_nodes=3))
    assert labels(nodes) == ["Alice", "Bob", "Carol"] and edges.count() == 3
    nodes, edges = model.get_graph(f=GraphFilter(limit_nodes=3, limit_edges=1))
    assert labels(nodes) == ["Alice", "Bob"] and [r["total_frequency"] for r in edges.collect()] == [3]
    nodes, edges = model.expand([4])
    assert len(labels(nodes)) == 4 and edges.count() == 6
    nodes, edges = model.expand([4], f=GraphFilter(minimum_node_frequency=3))
    assert labels(nodes) == ["Alice", "Bob", "Dave"] and edges.count() == 3
    _, edges = model.get_subgraph([1, 4], f=GraphFilter(minimum_node_frequency=3))
    assert [(r["source"], r["target"]) for r in edges.collect()] == [(1, 4)]
    nodes, _ = model.get_graph(f=GraphFilter(latest_date=dt.date(2024, 2, 15)))
    assert labels(nodes) == ["Alice", "Bob", "Carol"]
    nodes, _ = model.get_graph(f=GraphFilter(categories={"category": ["A"]}, blacklisted_entity_ids=[2]))
    assert "Bob" not in labels(nodes)
    lonely = model.expand([4], f=GraphFilter(minimum_edge_frequency=9))[0]
    assert labels(lonely) == ["Dave"]


def test_communities(model):
    members, metrics = model.find_communities("connected_components", min_weight=0.5)
    assert sorted((r["community"], r["id"]) for r in members.collect()) == [(1, 1), (2, 2), (3, 3), (3, 4)]
    row = metrics.filter("community = 3").first()
    assert (row["density"], row["conductance"], round(row["avg_weight"], 6), row["score"]) == (1.0, 0.0, 0.653213, 1.0)
    members, metrics = model.find_communities("k_clique", k=3)
    assert members.count() == 4 and round(metrics.first()["avg_weight"], 6) == 0.50647
    members, _ = model.find_communities("louvain")
    assert members.select("id").distinct().count() == members.count() == 4
    members, _ = model.find_communities(lambda v, e: [set(v["id"])])
    assert members.count() == 4
    with pytest.raises(ValueError):
        model.find_communities("unknown")


def test_search_and_bounds(model):
    assert [r["label"] for r in model.search("a").collect()] == ["Alice", "Carol", "Dave"]
    assert model.bounds().first()["max_node_frequency"] == 3
    assert model.connection_types == ["cooccurrence"]


def test_relations(spark):
    m = NarrativeModel(spark).fit(["Alice met Bob.", "Carol visited Dave."])
    assert {(r["subject"], r["predicate"], r["object"], round(r["significance"], 6)) for r in m.relations.collect()} == {("Alice", "met", "Bob.", 0.30103), ("Carol", "visited", "Dave.", 0.30103)}
    nodes, edges = m.get_graph("relation")
    assert nodes.count() == 4 and sorted(r["label"] for r in edges.collect()) == ["met", "visited"]
    assert m.connection_types == ["relation", "cooccurrence"] and m.predicates.count() == 2 and m.triplets.count() == 2


def test_lifecycle(spark, tmp_path, model):
    path = str(tmp_path / "m")
    saved = model.save(path)
    assert saved.endswith(".model")
    with pytest.raises(FileExistsError):
        model.save(path)
    model.save(path, overwrite=True)
    again = CooccurrenceModel.load(spark, path)
    assert again.entities.count() == 4 and again.cooccurrences.count() == 6
    with pytest.raises(FileNotFoundError):
        CooccurrenceModel.load(spark, str(tmp_path / "none"))
    with pytest.raises(FileExistsError):
        store.open_model(spark, path)
    reused = CooccurrenceModel.open(spark, path, "reuse")
    reused.fit([*TEXTS, "Eve met Alice."], doc_ids=[1, 2, 3, 4])
    assert reused.entities.count() == 5 and reused.tables["documents"].count() == 4
    assert store.open_model(spark, path, "overwrite") == {}
    with pytest.raises(ValueError):
        store.open_model(spark, path, "other")


def test_grouped_relations_and_focus(spark):
    rows = spark.createDataFrame([(1, "x", "y", "p", 1, 0.5), (2, "x", "y", "q", 2, 0.9), (3, "x", "y", "r", 3, 0.1), (4, "x", "y", "s", 4, 0.7), (5, "y", "x", "p", 1, 0.2)], "id long, source string, target string, predicate_label string, frequency long, significance double")
    got = {(r["source"], r["target"]): (r["label"], r["total_frequency"], [g["id"] for g in r["group"]]) for r in graph.group_relations(rows).collect()}
    assert got == {("x", "y"): ("q, s, p, ...", 10, [2, 4, 1, 3]), ("y", "x"): ("p", 1, [5])}


def test_filter_names():
    assert GraphFilter.parse({"limit_nodes": 3}).limit_nodes == 3
    with pytest.raises(ValueError):
        GraphFilter.parse({"limit": 3})


def test_merged_contexts(spark):
    spans = spark.createDataFrame([(1, 5, 9), (1, 0, 5), (1, 6, 7), (1, 10, 12), (1, 5, 9), (2, 0, 3)], "doc_id long, context_start int, context_end int")
    assert sorted((r["doc_id"], r["context_start"], r["context_end"], r["n_spans"]) for r in contexts.merged(spans).collect()) == [(1, 0, 9, 4), (1, 10, 12, 1), (2, 0, 3, 1)]
    whole = contexts.with_text(spark.createDataFrame([(1, None, None)], "doc_id long, context_start int, context_end int"), spark.createDataFrame([(1, "abc")], "doc_id long, text string"))
    assert [(r["context_start"], r["context"]) for r in whole.collect()] == [(0, "abc")]


def test_segments_and_colours(spark):
    docs = spark.createDataFrame([(1, "Alice met Bob")], "doc_id long, text string")
    h = spark.createDataFrame([(1, 0, 5, "subject"), (1, 6, 9, "predicate"), (1, 10, 13, "object")], "doc_id long, span_start int, span_end int, role string")
    parts = contexts.segments(docs, h)
    assert [(r["segment"], r["roles"]) for r in parts.orderBy("segment_start").collect()] == [("Alice", ["subject"]), (" ", []), ("met", ["predicate"]), (" ", []), ("Bob", ["object"])]
    assert contexts.ansi(parts).first()["highlighted"] == "\033[34mAlice\033[0m \033[33mmet\033[0m \033[31mBob\033[0m"


def test_streaming_counts(spark, tmp_path):
    rows = [(1, "Alice met Bob.", dt.datetime(2024, 1, 1, 10)), (2, "Alice left.", dt.datetime(2024, 1, 1, 12)), (3, "Dave ran.", dt.datetime(2024, 1, 9))]
    spark.createDataFrame(rows, "doc_id long, text string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string, ts timestamp").parquet(str(tmp_path / "in"))
    q = incremental.mention_counts(stream, "ts").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["span_text"], r["frequency"]) for r in spark.table("counts").collect()} == {("Alice", 2), ("Bob", 1), ("Dave", 1)}
    seen = []
    incremental.ingest(stream.select("doc_id", "text"), lambda df: seen.extend(r["doc_id"] for r in df.select(F.col("doc_id")).collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [1, 2, 3]


def test_every_fit_adds_its_documents(spark):
    m = CooccurrenceModel(spark, mapper="identity").fit(["Alice met Bob.", "Alice met Bob."]).fit(["Dave ran.", "Alice met Bob."])
    assert m.tables["documents"].count() == 4 and sorted(r["doc_id"] for r in m.tables["documents"].collect()) == [1, 2, 3, 4]
    assert {r["label"]: r["frequency"] for r in m.entities.collect()} == {"Alice": 3, "Bob": 3, "Dave": 1}
    m = CooccurrenceModel(spark).fit(["Alice ran.", "Bob ran."], doc_ids=["x", "y"]).fit(["Carol ran.", "Bob ran."], doc_ids=["z", "y"])
    assert sorted(r["str_id"] for r in m.tables["documents"].collect()) == ["x", "y", "z"]
    rows = spark.createDataFrame([("Eve ran.",), ("Eve ran.",)], "text string")
    m = CooccurrenceModel(spark).fit(documents.documents(rows)).fit(documents.documents(rows))
    assert m.tables["documents"].count() == 4 == m.tables["documents"].select("doc_id").distinct().count()


def test_saved_options_and_saving_over_itself(spark, tmp_path):
    path = str(tmp_path / "own")
    CooccurrenceModel(spark, window=None, boundary=r"\n+", mapper="lower").fit(TEXTS).save(path)
    m = CooccurrenceModel.load(spark, path)
    assert (m.window, m.boundary, m.options["mapper"]) == (None, r"\n+", "lower")
    m.save(path, overwrite=True)
    m.fit(["Zoe ran."]).save(path, overwrite=True)
    assert CooccurrenceModel.load(spark, path).entities.count() == 5
    assert CooccurrenceModel.load(spark, path, window=2).window == 2


def test_pronouns_stand_for_their_antecedents(spark):
    def clusters(docs):
        return docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(0).alias("cluster"), F.lit(s).alias("span_start"), F.lit(e).alias("span_end"), F.lit(t).alias("span_text"), F.lit(p).alias("is_pronoun")) for s, e, t, p in ((0, 5, "Alice", False), (13, 16, "She", True))])).alias("m")).select("doc_id", "m.*")

    m = CooccurrenceModel(spark, coref=clusters, window=1).fit(["Alice slept. She saw Bob. He ran."])
    assert {r["label"]: r["frequency"] for r in m.entities.collect()} == {"Alice": 2, "Bob": 1, "He": 1}
    assert [r["label"] for r in m._labels().orderBy("label").collect()] == ["Alice", "Bob", "He"]
    assert {(r["entity_one"], r["entity_two"]) for r in m.cooccurrences.collect()} == {("Alice", "Bob"), ("Alice", "Alice"), ("Alice", "He"), ("Bob", "He")}


def test_exports_and_details(spark):
    m = NarrativeModel(spark, mapper="lower", predicate_mapper="lower").fit(["Alice met Bob", "ALICE Met Bob"], categories={"genre": ["x", ["y", "x"]]})
    [t, _] = m.triplets.orderBy("doc_id").collect()
    assert (t["subject_label"], t["subject_span_text"], t["subject_span_end"], t["predicate_label"], t["object_label"], t["object_span_start"]) == ("ALICE", "Alice", 5, "Met", "Bob", 10)
    [p, _] = m.tuplets.orderBy("doc_id").collect()
    assert (p["entity_one_label"], p["entity_one_span_text"], p["entity_two_label"], p["entity_two_span_start"]) == ("ALICE", "Alice", "Bob", 10)
    [r] = m.relations.collect()
    assert r["alt_pred_labels"] == ["met"] and r["genre"] == ["x", "y"] and r["subject_entity_id"] == t["subject_entity_id"] and r["predicate_id"] == t["predicate_id"]
    assert [x["genre"] for x in m.cooccurrences.collect()] == [["x", "y"]] == [x["genre"] for x in m.predicates.collect()]
    assert sorted(x["genre"] for x in m.documents.collect()) == [["x"], ["x", "y"]]
    d = m.entity_details([t["subject_entity_id"]]).first()
    assert (d["label"], d["alt_labels"], d["categories"], d["stats"]["frequency"]) == ("ALICE", ["Alice"], {"genre": ["x", "y"]}, 2)
    assert m.relation_details().first()["alt_labels"] == ["met"] and m.predicate_details().first()["stats"]["frequency"] == 2
    assert m.cooccurrence_details().first()["stats"]["pmi"] is not None
    assert len(m.document(1)["mentions"]) == 2 and len(m.document(1)["tuplets"]) == 1
    assert [x["n_matched"] for x in m.documents_of([1, 2], limit=1, offset=1).collect()] == [2]


def test_long_id_lists(spark):
    ids = list(range(0, 4000, 2))
    rows = spark.range(0, 4000)
    assert lookup.has_id(rows, "id", ids).count() == 2000 == lookup.has_id(rows, "id", ids, wanted=False).count()
    assert lookup.with_flag(rows, "id", ids, "even").filter("even").count() == 2000
    assert lookup.page(rows, ["id"], 3, 2).collect() == rows.filter("id BETWEEN 2 AND 4").collect()


def test_edges_inside_communities(spark):
    m = CooccurrenceModel(spark, window=0).fit(["Alice met Bob. Carol met Dave.", "Alice saw Bob."])
    members, _ = m.find_communities("connected_components")
    got = {r["community"]: [(e["a"], e["b"]) for e in r["edges"]] for r in m.community_edges(members).collect()}
    assert got == {1: [(1, 2)], 3: [(3, 4)]}
