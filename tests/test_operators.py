"""Extraction, mapping, dependency rules, sources and analyses on small inputs."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from threadloom.functions.porter2 import stem
from threadloom.functions.lemma import lemma
from threadloom.operators import analytics, community, cooccur, dependency, extract, lookup, mapping, stats
from threadloom.session import arrow_batch_records
from threadloom.sources import documents


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def spans(df):
    return sorted((r["doc_id"], r["span_start"], r["span_end"], r["span_text"]) for r in df.collect())


def test_mentions_follow_the_rule(spark):
    texts = ["Alice met Bob.", ",Alice! (Bob) x", "", "é Élan 😀 Zoë.", "A A"]
    want = []
    for i, t in enumerate(texts, 1):
        for m in re.finditer(r"\S+", t):
            label = m[0].strip(".,!?;:")
            if label and label[0].isupper():
                want.append((i, m.start(), m.start() + len(label), label))
    assert spans(extract.mentions(docs(spark, *texts))) == sorted(want)
    assert extract.mentions(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0


def test_other_extractors(spark):
    d = docs(spark, "Dr. Who met New York fans in York")
    assert spans(extract.mentions(d, extract.gazetteer_extractor(["York", "New York", "Dr."]))) == [(1, 12, 20, "New York"), (1, 29, 33, "York")]
    assert spans(extract.mentions(d, extract.python_extractor(lambda t: [(m.start(), m.end(), m[0]) for m in re.finditer("[A-Z]ork", t)]))) == [(1, 16, 20, "York"), (1, 29, 33, "York")]


def test_chunks(spark):
    def bounds(df):
        return [(r["chunk"], r["chunk_start"], r["chunk_end"]) for r in df.orderBy("chunk").collect()]

    text = "Alice met Bob. Carol left.\n\nDave"
    assert bounds(extract.chunks(docs(spark, text))) == [(0, 0, 13), (1, 15, 25), (2, 28, 32)]
    assert bounds(extract.sentences(docs(spark, "First paragraph\n\nSecond paragraph"))) == [(0, 0, 15), (1, 17, 33)]
    assert bounds(extract.custom_chunks(docs(spark, "ab ab c"), lambda t: t.split())) == [(0, 0, 2), (1, 3, 5), (2, 6, 7)]


def test_document_pairs(spark):
    m = extract.mentions(docs(spark, "Alice met Bob. Carol left."))
    assert sorted((r["one_text"], r["two_text"]) for r in cooccur.document_tuplets(m).collect()) == [("Alice", "Bob"), ("Alice", "Carol"), ("Bob", "Carol")]


def test_greedy_spans(spark):
    rows = [(1, 0, 5, 1, 1, "a"), (1, 3, 9, 2, 0, "b"), (1, 9, 12, 1, 1, "c"), (1, 0, 3, 3, 1, "d")]
    got = extract.greedy_spans(spark.createDataFrame(rows, "doc_id long, span_start int, span_end int, n_tokens int, priority int, name string"))
    assert sorted(r["name"] for r in got.collect()) == ["b", "c", "d"]


def test_pronouns(spark):
    mentions = spark.createDataFrame([(1, 0, 0, 5, "Frodo", False), (1, 0, 12, 14, "He", True), (1, 1, 20, 22, "it", True)], "doc_id long, cluster int, span_start int, span_end int, span_text string, is_pronoun boolean")
    found = spark.createDataFrame([(1, 0, 5, "Frodo"), (1, 12, 14, "He"), (1, 20, 22, "it"), (1, 30, 35, "Paris")], "doc_id long, span_start int, span_end int, span_text string")
    got = extract.resolve_pronouns(found, mentions).orderBy("span_start").collect()
    assert [(r["span_start"], r["span_text"], r["is_coref_resolved"]) for r in got] == [(0, "Frodo", False), (12, "Frodo", True), (30, "Paris", False)]


def test_triplet_rules(spark):
    got = extract.leading_triplets(docs(spark, "Alice met Bob.", "one two")).collect()
    assert [(r["subj_text"], r["pred_text"], r["obj_text"], r["obj_start"], r["obj_end"]) for r in got] == [("Alice", "met", "Bob.", 10, 14)]
    got = extract.adjacent_triplets(docs(spark, "John visited Paris. Mary Tom. Ann went by a very long road to Rome."))
    assert [(r["subj_text"], r["pred_text"], r["obj_text"]) for r in got.collect()] == [("John", "visited", "Paris")]


def labelled(spark, counts):
    return spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "label string")


def mapped(df):
    return {r["label"]: r["canonical"] for r in df.collect()}


def test_mapping(spark):
    assert set(mapped(mapping.normalized(labelled(spark, {"cat": 1, "cats": 1}), mapping.stem)).values()) == {"cats"}
    assert set(mapped(mapping.normalized(labelled(spark, {"natural language": 1, "Natural Language": 1}))).values()) == {"Natural Language"}
    both = {"the cat": 2, "cat": 1}
    assert set(mapped(mapping.normalized(labelled(spark, both), ranking="shortest")).values()) == {"cat"}
    assert set(mapped(mapping.normalized(labelled(spark, both), ranking="most_frequent")).values()) == {"the cat"}
    assert mapped(mapping.normalized(labelled(spark, {"the": 1}))) == {"the": "the"}
    sub = labelled(spark, {"dark lord": 20, "the dark lord sauron": 3, "dark lords": 2, "lord": 40})
    assert mapped(mapping.subgrams(sub)) == {"dark lord": "dark lord", "the dark lord sauron": "dark lord", "dark lords": "dark lords", "lord": "lord"}

    def fails(_):
        raise KeyError

    assert mapped(mapping.normalized(labelled(spark, {"A": 1, "a": 2}), mapping.fallback(fails, str.lower))) == {"A": "a", "a": "a"}


def test_ranked_ids(spark):
    df = spark.range(0, 500).select(F.format_string("w%05d", (F.col("id") * 37) % 500).alias("label"))
    got = {r["label"]: r["id"] for r in mapping.ranked_ids(df, ["label"]).collect()}
    assert got == {f"w{i:05d}": i + 1 for i in range(500)}


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("consign", "consign"), ("consigned", "consign"), ("consistency", "consist"), ("knightly", "knight"), ("generously", "generous"), ("caresses", "caress"),
        ("ties", "tie"), ("cries", "cri"), ("gaps", "gap"), ("kiwis", "kiwi"), ("gas", "gas"), ("luxuriated", "luxuri"), ("hopping", "hop"), ("hoping", "hope"),
        ("say", "say"), ("by", "by"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("skies", "sky"), ("dying", "die"),
        ("proceed", "proceed"), ("inning", "inning"), ("controlling", "control"), ("adjustable", "adjust"), ("replacement", "replac"), ("communism", "communism"), ("beautiful", "beauti"),
    ],
)
def test_stems(word, want):
    assert stem(word) == want


def test_normalize_categories():
    f = documents.normalize_categories
    assert f(["a", "b"], 2) == [{"category": ["a"]}, {"category": ["b"]}]
    assert f([["a", "b"], []], 2) == [{"category": ["a", "b"]}, {"category": []}]
    assert f([{"x": "a"}, {"x": ["b"], "y": "c"}], 2) == [{"x": ["a"]}, {"x": ["b"], "y": ["c"]}]
    assert f({"x": ["a", ["b", "c"]]}, 2) == [{"x": ["a"]}, {"x": ["b", "c"]}]
    assert f(None, 2) == [{}, {}] and f([], 0) == []
    for bad in ({"x": "a"}, {"x": ["a"]}, ["a", {"x": "b"}], "ab"):
        with pytest.raises(ValueError):
            f(bad, 2)


def test_documents(spark, tmp_path):
    src = spark.createDataFrame([("a", "t1", "2024-01-02", "x", 5), ("b", "t2", None, None, None)], "key string, body string, day string, kind string, score int")
    out = {r["str_id"]: r for r in documents.documents(src, "body", "key", "day", categories=["kind"], metadata=["score"]).collect()}
    assert str(out["a"]["timestamp"]) == "2024-01-02" and out["a"]["categories"] == {"kind": ["x"]} and out["b"]["categories"] == {} and out["a"]["metadata"] == {"score": "5"}
    (tmp_path / "d.jsonl").write_text('{"text": "hello", "id": "7", "timestamp": "2024-05-01", "category": "c", "metadata": {"author": "me"}}\n')
    row = documents.read_jsonl(spark, str(tmp_path)).first()
    assert (row["text"], row["str_id"], row["categories"], row["metadata"]) == ("hello", "7", {"category": ["c"]}, {"author": "me"})
    parts = documents.sections(spark.createDataFrame([("b", "one\n\ntwo\n\n\nthree")], "title string, text string")).collect()
    assert [r["text"].strip() for r in parts] == ["one", "two", "three"]
    with pytest.raises(ValueError):
        documents.from_lists(spark, ["a"], doc_ids=[1, 2])


def sentence(spark, rows, chunks):
    tokens, at = [], 0
    for i, (text, pos, dep, head) in enumerate(rows):
        tokens.append((1, 0, i, at, at + len(text), text, pos, dep, head))
        at += len(text) + 1
    t = spark.createDataFrame(tokens, "doc_id long, sent_id int, i int, start int, end int, text string, pos string, dep string, head int")
    return t, spark.createDataFrame([(1, 0, s, e) for s, e in chunks], "doc_id long, sent_id int, start_i int, end_i int")


ACTIVE = [("John", "PROPN", "nsubj", 1), ("hit", "VERB", "ROOT", 1), ("the", "DET", "det", 3), ("ball", "NOUN", "dobj", 1)]
PASSIVE = [("The", "DET", "det", 1), ("ball", "NOUN", "nsubjpass", 3), ("was", "AUX", "auxpass", 3), ("hit", "VERB", "ROOT", 3), ("by", "ADP", "agent", 3), ("John", "PROPN", "pobj", 4)]
PREP = [("Mary", "PROPN", "nsubj", 1), ("went", "VERB", "ROOT", 1), ("to", "ADP", "prep", 1), ("London", "PROPN", "pobj", 2)]
CONJ = [("Ann", "PROPN", "nsubj", 1), ("cooked", "VERB", "ROOT", 1), ("fish", "NOUN", "dobj", 1), ("and", "CCONJ", "cc", 1), ("ate", "VERB", "conj", 1), ("rice", "NOUN", "dobj", 4)]
NOUN = [("The", "DET", "det", 1), ("king", "NOUN", "nsubj", 4), ("of", "ADP", "prep", 1), ("France", "PROPN", "pobj", 2), ("slept", "VERB", "ROOT", 4)]
SHE = [("Alice", "PROPN", "nsubj", 1), ("slept", "VERB", "ROOT", 1), ("and", "CCONJ", "cc", 1), ("she", "PRON", "nsubj", 4), ("ate", "VERB", "conj", 1), ("bread", "NOUN", "dobj", 4)]
WENT = [("Alice", "PROPN", "nsubj", 1), ("stayed", "VERB", "ROOT", 1), ("home", "ADV", "advmod", 1), ("and", "CCONJ", "cc", 1), ("went", "VERB", "conj", 1), ("to", "ADP", "prep", 4), ("Paris", "PROPN", "pobj", 5)]
FOND = [("Alice", "PROPN", "nsubj", 1), ("fond", "ADJ", "ROOT", 1), ("tea", "NOUN", "dobj", 1)]
PRON = [("He", "PRON", "nsubj", 1), ("saw", "VERB", "ROOT", 1), ("Rome", "PROPN", "dobj", 1)]


@pytest.mark.parametrize(
    ("rows", "chunks", "want"),
    [
        (ACTIVE, [(0, 1), (2, 4)], [("John", "hit", "the ball")]),
        (PASSIVE, [(0, 2), (5, 6)], [("John", "hit", "The ball")]),
        (PREP, [(0, 1), (3, 4)], [("Mary", "went", "London")]),
        (CONJ, [(0, 1), (2, 3), (5, 6)], [("Ann", "cooked", "fish"), ("Ann", "ate", "rice")]),
        (NOUN, [(0, 2), (3, 4)], [("The king", "of", "France")]),
        (PRON, [(0, 1), (2, 3)], []),
        (SHE, [(0, 1), (3, 4), (5, 6)], []),
        (WENT, [(0, 1), (6, 7)], [("Alice", "went", "Paris")]),
    ],
)
def test_dependency_rules(spark, rows, chunks, want):
    got = dependency.dependency_triplets(*sentence(spark, rows, chunks)).collect()
    assert sorted((r["subj_text"], r["pred_text"], r["obj_text"]) for r in got) == sorted(want)


@pytest.mark.parametrize(
    ("rows", "chunks", "want"),
    [
        (ACTIVE, [(0, 1), (2, 4)], [("John", "hit", "the ball")]),
        (PASSIVE, [(0, 2), (5, 6)], [("John", "hit", "The ball")]),
        (PREP, [(0, 1), (3, 4)], [("Mary", "went to", "London")]),
        (CONJ, [(0, 1), (2, 3), (5, 6)], [("Ann", "cooked", "fish"), ("Ann", "ate", "rice")]),
        (NOUN, [(0, 2), (3, 4)], [("The king", "of", "France")]),
    ],
)
def test_path_patterns(spark, rows, chunks, want):
    got = dependency.entity_pair_triplets(*sentence(spark, rows, chunks)).collect()
    assert sorted((r["subj_text"], r["pred_text"], r["obj_text"]) for r in got) == sorted(want)


def test_components_and_cliques(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (100, 102), (102, 103), (101, 103)]
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, weight double")
    v = spark.createDataFrame([(i,) for i in [*range(1, 61), *range(100, 104), 500]], "id long")
    got = {r["id"]: r["community"] for r in community.connected(v, e).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[103] == 100 and got[500] == 500
    assert sorted(r["members"] for r in community.k_cliques(e, 3).collect()) == [[100, 101, 102], [101, 102, 103]]
    found = community.clique_percolation(e, 3)
    assert sorted(r["id"] for r in found.collect()) == [100, 101, 102, 103] and found.select("community").distinct().count() == 1
    two = community.louvain_partition([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (4, 5, 1.0), (5, 6, 1.0), (4, 6, 1.0), (3, 4, 0.1)])
    assert len({two[1], two[2], two[3]}) == 1 and len({two[4], two[5], two[6]}) == 1 and two[1] != two[4]
    q = community.modularity(community.connected(v, e), e).first()["modularity"]
    assert 0 < q < 1


def test_statistics_and_lookups(spark):
    d = spark.createDataFrame([(1, None, 0), (2, None, 5)], "doc_id long, timestamp date, timestamp_ordinal int")
    got = stats.with_defaults(spark.createDataFrame([("x",), ("y",)], "label string"), stats.text_stats(spark.createDataFrame([(1, "x"), (1, "x"), (2, "x")], "doc_id long, label string"), d, ["label"]), ["label"])
    rows = {r["label"]: (r["frequency"], r["doc_frequency"], r["adjusted_tf_idf"], r["first_occurrence_ordinal"]) for r in got.collect()}
    assert rows == {"x": (3, 2, 2 * 2 / 3, 0), "y": (-1, -1, -1.0, None)}
    n = spark.createDataFrame([(1, "a", 3), (2, "b", 2)], "id long, label string, frequency long")
    assert lookup.get_single(n, 2)["label"] == "b"
    with pytest.raises(lookup.NotFoundError):
        lookup.get_single(n, 9)
    assert lookup.get_multiple(n, [2, 9]).count() == 1 and lookup.get_multiple(n, limit=1).count() == 1
    assert lookup.drop_empty_columns(n.withColumn("e", F.lit(None).cast("int"))).columns == n.columns
    assert analytics.without_giants([3, 4, 5, 12, 13]) == [3, 4, 5]
    compared = analytics.compare_models(n, spark.createDataFrame([("b", 5), ("c", 1)], "label string, frequency long"))
    assert {(r["label"], r["change"], r["side"]) for r in compared.collect()} == {("a", -3, "only_a"), ("b", 3, "shared"), ("c", 1, "only_b")}
    both = spark.range(1).select(stats.combine_category_maps(F.expr("map('x', array('a'))"), F.expr("map('x', array('b'), 'y', array('c'))")).alias("m")).first()["m"]
    assert both == {"x": ["a", "b"], "y": ["c"]}


def test_path_patterns_ask_for_the_ancestor(spark):
    got = dependency.entity_pair_triplets(*sentence(spark, WENT, [(0, 1), (6, 7)])).collect()
    assert [(r["subj_text"], r["pred_text"], r["obj_text"]) for r in got] == [("Alice", "went", "Paris")]
    assert dependency.entity_pair_triplets(*sentence(spark, FOND, [(0, 1), (2, 3)])).collect() == []


def test_allowed_entities(spark):
    tokens, chunks = sentence(spark, ACTIVE, [(0, 1), (2, 4)])
    nouns = dependency.Allowed(named=(1, None), nouns=(2, None))
    assert dependency.dependency_triplets(tokens, chunks, allowed=nouns).collect() == []  # one token that isn't named
    named = tokens.withColumn("ent", F.when(F.col("i") == 0, "PERSON"))
    assert dependency.dependency_triplets(named, chunks, allowed=nouns).count() == 1
    spans = spark.createDataFrame([(1, True), (1, False), (3, False)], "n_tokens int, is_named boolean")
    assert extract.allowed_entities(spans).count() == 2 and extract.allowed_entities(spans, named=False, nouns=(1, 3)).count() == 1


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("cats", "cat"), ("boxes", "box"), ("parties", "party"), ("men", "man"), ("went", "go"), ("running", "run"), ("hoping", "hope"), ("hopped", "hop"), ("visited", "visit"),
        ("studied", "study"), ("glass", "glass"), ("news", "news"), ("analyses", "analysis"), ("Was", "be"), ("king", "king"), ("created", "create"), ("Hobbits", "hobbit"), ("bus", "bus"),
        ("x1s", "x1s"), ("", ""),
    ],
)
def test_lemmas(word, want):
    assert lemma(word) == want


def test_lemma_mappers(spark):
    got = mapped(mapping.PRESETS["lemmatization"](labelled(spark, {"the dark lords": 1, "dark lord": 2, "Dark Lord": 1})))
    assert set(got.values()) == {"dark lord"}
    got = mapped(mapping.PRESETS["subgram_lemmatization"](labelled(spark, {"dark lord": 20, "dark lords of Mordor": 3})))
    assert set(got.values()) == {"dark lord"}


def test_batch_sizes():
    assert [arrow_batch_records(n, c) for n, c in ((50, 1), (50, 16), (400, 8), (1999, 4), (4000, 2), (9000, 1))] == [1000, 2000, 1000, 200, 100, 50]


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components_either_way(spark, one_task):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (60, 100), (7, 7)], "a long, b long")
    got = {r["a"]: r["b"] for r in community.stars(edges, one_task).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {60: 50, 100: 50}


def test_one_text_of_very_many_mentions(spark):
    """Extraction takes time in proportion to the text."""
    n = 100_000
    text = " ".join(f"Name{i % 977} went. " if i % 3 else "Name" for i in range(n))
    df = docs(spark, text)
    start = time.monotonic()
    assert cooccur.placed_mentions(df).count() == n
    assert extract.mentions(df, extract.regex_extractor(r"went")).count() == n - (n + 2) // 3
    assert time.monotonic() - start < 150  # over an hour if it were quadratic


def test_spans_are_taken_in_order(spark):
    rng = random.Random(4)
    rows = [(d, s, s + rng.randrange(1, 12), rng.randrange(1, 5), rng.randrange(2)) for d in range(3) for s in (rng.randrange(300) for _ in range(120))]
    kept = set()
    for d, s, e, n, p in sorted(set(rows), key=lambda r: (r[0], r[4], -r[3], r[1], r[2])):
        if not any(x == d and s < f and b < e for x, b, f in kept):
            kept.add((d, s, e))
    got = extract.greedy_spans(spark.createDataFrame(rows, "doc_id long, span_start int, span_end int, n_tokens int, priority int"))
    assert sorted(map(tuple, got.select("doc_id", "span_start", "span_end").collect())) == sorted(kept)


def test_phrases(spark):
    df = docs(spark, "The old king of northern France saw a dragon's lair, and then he wrote to Queen Anne.", "", "of the")
    got = [(r["span_start"], r["span_text"]) for r in extract.mentions(df, extract.phrase_extractor()).orderBy("span_start").collect()]
    assert got == [(4, "old king"), (16, "northern France saw"), (38, "dragon's lair"), (65, "wrote"), (74, "Queen Anne")]
    assert [r["span_text"] for r in extract.mentions(df, extract.phrase_extractor(low=2, high=2)).orderBy("span_start").collect()] == ["old king", "dragon's lair", "Queen Anne"]


def test_louvain_by_rounds_is_about_as_good(spark):
    rng = random.Random(8)
    pairs = {tuple(sorted((i, j))) for i in range(60) for j in range(60) if i != j and rng.random() < (0.5 if i // 12 == j // 12 else 0.03)}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "a long, b long, weight double")
    vertices = spark.range(0, 62)
    value = {}
    for one_task in (10**6, 0):
        members = community.louvain(vertices, edges, 1.0, one_task)
        rows = members.collect()
        assert sorted(r["id"] for r in rows) == list(range(62)) and all(r["community"] <= r["id"] for r in rows)
        value[one_task] = community.modularity(members, edges).first()[0]
    assert value[0] > 0.95 * value[10**6] > 0.4
