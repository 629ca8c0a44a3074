"""Every registered query of the network operators and its DuckDB twin."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import analytics, community, contexts, cooccur, extract, filters, graph, lookup, mapping, stats
from ..operators.filters import GraphFilter
from ..sources.scratch import written
from . import corpus as c
from . import sql

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _query(twin: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if twin is not None:
            _SQL[f.__name__] = twin
        return f

    return add


def _stats(df: DataFrame) -> DataFrame:
    return c.rounded(df, "adjusted_tf_idf")


# extraction


@_query(sql.query(sql.TEXT, "SELECT doc_id, s AS span_start, e AS span_end, label AS span_text FROM mentions"))
def mentions(spark, d):
    return extract.mentions(c.documents(spark, d))


@_query(r"""SELECT DISTINCT doc_id, w AS span_text FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ed\b')) AS w FROM documents)""")
def regex_mentions(spark, d):
    return extract.mentions(c.documents(spark, d), extract.regex_extractor(r"[A-Z][a-z]+ed\b")).select("doc_id", "span_text").distinct()


@_query(sql.query((sql.DOCS, sql.CHUNKS), "SELECT doc_id, chunk, cs AS chunk_start, ce AS chunk_end FROM chunks"))
def chunks(spark, d):
    return extract.chunks(c.documents(spark, d))


@_query(sql.query((*sql.TEXT, sql.CHUNKS, sql.PLACED), "SELECT doc_id, chunk, s AS span_start, e AS span_end, label AS span_text FROM inside"))
def chunk_assignment(spark, d):
    return cooccur.placed_mentions(c.documents(spark, d))


@_query(r"""SELECT doc_id, w[1] AS subj_text, w[2] AS pred_text, w[3] AS obj_text, CAST(instr(text, w[1]) - 1 AS INTEGER) AS subj_start,
    CAST(instr(text, w[2]) - 1 AS INTEGER) AS pred_start, CAST(instr(text, w[3]) - 1 AS INTEGER) AS obj_start
FROM (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS w FROM documents) WHERE len(w) >= 3""")
def leading_triplets(spark, d):
    return extract.leading_triplets(c.documents(spark, d)).select("doc_id", "subj_text", "pred_text", "obj_text", "subj_start", "pred_start", "obj_start")


@_query(sql.query((*sql.TEXT, sql.CHUNKS, sql.PLACED, r"""pairs AS (
    SELECT i.*, lead(s) OVER w AS s2, lead(e) OVER w AS e2, lead(label) OVER w AS label2 FROM inside i WINDOW w AS (PARTITION BY doc_id, chunk ORDER BY s)),
between_ AS (SELECT p.*, regexp_replace(substr(text, e + 1, s2 - e), '^\s+|\s+$', '', 'g') AS gap FROM pairs p JOIN docs USING (doc_id) WHERE s2 IS NOT NULL)"""), r"""
SELECT doc_id, label AS subj_text, s AS subj_start, e AS subj_end, gap AS pred_text, label2 AS obj_text, s2 AS obj_start, e2 AS obj_end
FROM between_ WHERE len(regexp_extract_all(gap, '\S+')) BETWEEN 1 AND 4"""))
def adjacent_triplets(spark, d):
    return extract.adjacent_triplets(c.documents(spark, d))


# long labels first; then single mentions and pairs of neighbours, which overlap one another, by length and start
_CANDIDATES = r"""neighbours AS (SELECT *, lead(e) OVER (PARTITION BY doc_id ORDER BY s) AS e2 FROM mentions),
cand AS (
    SELECT doc_id, s, e, 1 AS n, 0 AS priority FROM mentions WHERE length(label) > 6
    UNION ALL SELECT doc_id, s, e, 1, 1 FROM mentions WHERE length(label) <= 6
    UNION ALL SELECT doc_id, s, e2, 2, 1 FROM neighbours WHERE e2 - e < 20),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, n DESC, s, e) AS r FROM cand),
walk AS (
    SELECT doc_id, 0::BIGINT AS r, CAST([] AS STRUCT(s BIGINT, e BIGINT)[]) AS kept, max(r) AS many FROM ranked GROUP BY doc_id
    UNION ALL
    SELECT w.doc_id, c.r, CASE WHEN len(list_filter(w.kept, lambda k: k.s < c.e AND c.s < k.e)) = 0 THEN list_append(w.kept, {'s': c.s::BIGINT, 'e': c.e::BIGINT}) ELSE w.kept END, w.many
    FROM walk w JOIN ranked c ON c.doc_id = w.doc_id AND c.r = w.r + 1)"""


@_query(sql.query((*sql.TEXT, _CANDIDATES), "SELECT doc_id, CAST(k.s AS INTEGER) AS span_start, CAST(k.e AS INTEGER) AS span_end FROM (SELECT doc_id, unnest(kept) AS k FROM walk WHERE r = many)").replace("WITH ", "WITH RECURSIVE ", 1))
def greedy_spans(spark, d):
    m = extract.mentions(c.documents(spark, d))
    n = F.length("span_text")
    lead = F.lead("span_end").over(Window.partitionBy("doc_id").orderBy("span_start"))
    single = m.select("doc_id", "span_start", "span_end", F.lit(1).alias("n_tokens"), F.when(n > 6, 0).otherwise(1).alias("priority"))
    pair = m.withColumn("until", lead).filter(F.col("until") - F.col("span_end") < 20)
    pair = pair.select("doc_id", "span_start", F.col("until").alias("span_end"), F.lit(2).alias("n_tokens"), F.lit(1).alias("priority"))
    return extract.greedy_spans(single.unionByName(pair)).select("doc_id", "span_start", "span_end")


@_query(r"""WITH w AS (SELECT doc_id, k, t[k] AS token FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM documents))),
b AS (SELECT token AS a, lead(token) OVER (PARTITION BY doc_id ORDER BY k) AS b, lead(token, 2) OVER (PARTITION BY doc_id ORDER BY k) AS c3 FROM w),
n AS (SELECT token, count(*) AS n FROM w GROUP BY token), nb AS (SELECT a, b, count(*) AS n FROM b WHERE b IS NOT NULL GROUP BY a, b),
good AS (SELECT nb.a, nb.b FROM nb JOIN n x ON x.token = nb.a JOIN n y ON y.token = nb.b
    WHERE nb.n >= 3 AND ln((nb.n::DOUBLE / (SELECT sum(n) FROM nb)) / ((x.n::DOUBLE / (SELECT sum(n) FROM n)) * (y.n::DOUBLE / (SELECT sum(n) FROM n)))) >= -0.5),
phrases AS (SELECT DISTINCT a, b, c3 FROM b WHERE c3 IS NOT NULL)
SELECT a || ' ' || b || ' ' || c3 AS phrase FROM phrases SEMI JOIN good USING (a, b)""")
def bigram_filter(spark, d):
    return extract.good_threes(c.documents(spark, d).select("text"))


# co-occurrence and statistics


@_query(sql.query(sql.TEXT_TUPLETS, "SELECT doc_id, s1 AS one_start, l1 AS one_text, s2 AS two_start, l2 AS two_text, cs AS context_start, ce AS context_end FROM tuplets"))
def window_tuplets(spark, d):
    return cooccur.window_tuplets(c.documents(spark, d), 3).select("doc_id", "one_start", "one_text", "two_start", "two_text", "context_start", "context_end")


@_query(sql.query(sql.TEXT, "SELECT least(a.label, b.label) AS entity_one, greatest(a.label, b.label) AS entity_two, count(*) AS frequency FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND b.s > a.s GROUP BY ALL"))
def document_cooccurrences(spark, d):
    return cooccur.document_cooccurrences(c.documents(spark, d))


@_query(sql.query(sql.TEXT, "SELECT a.doc_id, a.s AS one_start, a.label AS one_text, b.s AS two_start, b.label AS two_text FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND b.s > a.s"))
def document_tuplets(spark, d):
    return cooccur.document_tuplets(extract.mentions(c.documents(spark, d))).select("doc_id", "one_start", "one_text", "two_start", "two_text")


@_query(sql.query(sql.TEXT_ENTITIES, f"SELECT label, {sql.STATS} FROM entities"))
def entity_stats(spark, d):
    return _stats(c.entities(spark, d))


@_query(sql.query(sql.TEXT_ENTITIES, "SELECT label, row_number() OVER (ORDER BY label) AS id FROM (SELECT label FROM entities)"))
def entity_ids(spark, d):
    return mapping.ranked_ids(c.mentions(spark, d).select("label").distinct(), ["label"])


@_query(sql.query((*sql.TEXT_TUPLETS, sql.PAIRS), f"SELECT one AS entity_one, two AS entity_two, {sql.STATS} FROM pairs"))
def cooc_stats(spark, d):
    return _stats(c.pairs(spark, d))


@_query(sql.query(sql.TEXT_COOCS, "SELECT one AS entity_one, two AS entity_two, frequency, round(pmi, 6) AS pmi FROM coocs"))
def cooc_pmi(spark, d):
    return c.rounded(c.cooccurrences(spark, d).select("entity_one", "entity_two", "frequency", "pmi"), "pmi")


@_query(sql.query((sql.STAR_DOCS, sql.STAR, sql.PREDICATES), f"SELECT predicate, {sql.STATS} FROM predicates"))
def predicate_stats(spark, d):
    return _stats(stats.text_stats(c.star_triplets(spark, d), c.star_documents(spark, d), ["predicate"]))


@_query(sql.query(sql.STAR_ALL, f"SELECT subject, predicate, object, {sql.STATS}, round(significance, 6) AS significance FROM relations"))
def relation_significance(spark, d):
    return c.rounded(_stats(c.star_relations(spark, d)), "significance")


@_query(sql.query((sql.STAR_DOCS, sql.STAR, sql.ENDS, sql.STAR_ENTITIES), f"SELECT label, {sql.STATS} FROM sentities"))
def star_entity_stats(spark, d):
    return _stats(c.star_nodes(spark, d).drop("id"))


@_query("""WITH o AS (SELECT l_orderkey AS doc_id, l_partkey AS p, l_linenumber AS n FROM lineitem)
SELECT least(a.p, b.p) AS entity_one, greatest(a.p, b.p) AS entity_two, count(*) AS frequency, count(DISTINCT a.doc_id) AS doc_frequency
FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.n > a.n GROUP BY ALL""")
def star_cooccurrences(spark, d):
    lines = c.table(spark, d, "lineitem")
    o = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("label"))
    return cooccur.ordered_cooccurrences(o, c.parts_for(lines))


_ATTR = """cats AS (SELECT doc_id, 'lang' AS name, lang AS value FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents)"""


@_query(sql.query((*sql.TEXT, _ATTR), "SELECT DISTINCT label, name, value FROM mentions JOIN cats USING (doc_id)"))
def category_propagation(spark, d):
    return stats.target_categories(c.mentions(spark, d), c.attributes(spark, d), ["label"])


@_query(sql.query((*sql.TEXT, _ATTR), """SELECT label, array_to_string(list_sort(list(DISTINCT value) FILTER (name = 'lang')), ',') AS lang, array_to_string(list_sort(list(DISTINCT value) FILTER (name = 'source')), ',') AS source
FROM mentions JOIN cats USING (doc_id) GROUP BY label"""))
def category_pivot(spark, d):
    wide = stats.category_pivot(stats.target_categories(c.mentions(spark, d), c.attributes(spark, d), ["label"]), ["label"], ["lang", "source"])
    return wide.select("label", F.array_join("lang", ",").alias("lang"), F.array_join("source", ",").alias("source"))


@_query(sql.query(sql.TEXT, "SELECT lower(label) AS canonical, array_to_string(list_sort(list(DISTINCT label)), ',') AS alt_labels FROM mentions WHERE label <> lower(label) GROUP BY 1"))
def alt_labels(spark, d):
    out = stats.alt_labels(c.mentions(spark, d).withColumn("canonical", F.lower("label")), "canonical", "label")
    return out.select("canonical", F.array_join("alt_labels", ",").alias("alt_labels"))


@_query(sql.query(sql.TEXT_COOCS, """SELECT min(ts) AS min_timestamp, max(ts) AS max_timestamp, min(ord) AS min_timestamp_ordinal, max(ord) AS max_timestamp_ordinal,
(SELECT min(frequency) FROM entities) AS min_node_frequency, (SELECT max(frequency) FROM entities) AS max_node_frequency,
(SELECT min(frequency) FROM pairs) AS min_edge_frequency, (SELECT max(frequency) FROM pairs) AS max_edge_frequency FROM docs"""))
def data_bounds(spark, d):
    return stats.bounds(c.attributes(spark, d), c.entities(spark, d), c.pairs(spark, d))


@_query("SELECT 'lang' AS name, array_to_string(list_sort(list(DISTINCT lang)), ',') AS \"values\" FROM documents UNION ALL SELECT 'source', array_to_string(list_sort(list(DISTINCT source)), ',') FROM documents")
def category_values(spark, d):
    return stats.category_values(c.attributes(spark, d)).select("name", F.array_join("values", ",").alias("values"))


# mapping

# labels are single words, so the rankings agree, and the first in code-point order is the least string
_NORM = sql.query((*sql.TEXT, """counts AS (SELECT label, count(*) AS n FROM mentions GROUP BY label),
ranked AS (SELECT label, first_value(label) OVER (PARTITION BY lower(label) ORDER BY n DESC, label) AS canonical FROM counts)"""), "SELECT label, canonical FROM ranked")


@_query(_NORM)
def normalize_shortest(spark, d):
    return mapping.normalized(c.mentions(spark, d).select("label"), mapping.lower, "shortest")


@_query(_NORM)
def normalize_most_frequent(spark, d):
    return mapping.normalized(c.mentions(spark, d).select("label"), mapping.lower, "most_frequent")


@_query()
def stem_map(spark, d):
    return mapping.normalized(c.mentions(spark, d).select("label"), mapping.stem)


@_query("""WITH base AS (SELECT p_name AS label FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT p_type || ' of ' || p_brand FROM part),
counts AS (SELECT label, count(*) AS n FROM base GROUP BY label),
cand AS (SELECT label AS main, n AS mn FROM counts WHERE n >= 10 AND len(string_split(lower(label), ' ')) >= 2),
hits AS (SELECT c.label, main, mn FROM counts c JOIN cand ON contains(' ' || lower(c.label) || ' ', ' ' || lower(main) || ' ') AND mn >= 2.0 * c.n AND main <> c.label),
best AS (SELECT label, first_value(main) OVER (PARTITION BY label ORDER BY len(string_split(main, ' ')), mn DESC, main) AS main FROM hits),
one AS (SELECT DISTINCT label, main FROM best)
SELECT label, CASE WHEN label IN (SELECT main FROM one) THEN label ELSE coalesce(main, label) END AS canonical FROM counts LEFT JOIN one USING (label)""")
def subgram_map(spark, d):
    part = c.table(spark, d, "part")
    labels = part.select(F.col("p_name").alias("label")).unionByName(part.select(F.col("p_type").alias("label"))).unionByName(part.select(F.concat("p_type", F.lit(" of "), "p_brand").alias("label")))
    return mapping.subgrams(labels)


# filters

_F_NODES = "SELECT label AS id, frequency FROM entities"


@_query(sql.query(sql.TEXT_ENTITIES, f"{_F_NODES} WHERE last_occurrence >= DATE '2024-06-01' AND first_occurrence <= DATE '2024-09-30'"))
def filter_dates(spark, d):
    return filters.entities(c.nodes(spark, d), GraphFilter(earliest_date=dt.date(2024, 6, 1), latest_date=dt.date(2024, 9, 30))).select("id", "frequency")


@_query(sql.query(sql.TEXT_ENTITIES, f"{_F_NODES} WHERE last_occurrence_ordinal >= 100 AND first_occurrence_ordinal <= 500"))
def filter_ordinals(spark, d):
    return filters.entities(c.nodes(spark, d), GraphFilter(minimum_ordinal_time=100, maximum_ordinal_time=500)).select("id", "frequency")


@_query(sql.query((*sql.TEXT_ENTITIES, _ATTR), f"""{_F_NODES} WHERE label IN (SELECT label FROM mentions JOIN cats USING (doc_id) WHERE name = 'lang' AND value IN ('fr', 'de'))
AND label IN (SELECT label FROM mentions JOIN cats USING (doc_id) WHERE name = 'source' AND value = 'src1')"""))
def filter_categories(spark, d):
    cats = stats.target_categories(c.mentions(spark, d), c.attributes(spark, d), ["label"]).withColumnRenamed("label", "id")
    return filters.entities(c.nodes(spark, d), GraphFilter(categories={"lang": ["fr", "de"], "source": ["src1"]}), cats).select("id", "frequency")


@_query(sql.query(sql.TEXT_ENTITIES, f"{_F_NODES} WHERE frequency BETWEEN 5 AND 50 AND doc_frequency >= 3 AND label NOT IN ('The', 'La')"))
def filter_frequencies(spark, d):
    f = GraphFilter(minimum_node_frequency=5, maximum_node_frequency=50, minimum_node_doc_frequency=3, blacklisted_entity_ids=["The", "La"])
    return filters.entities(c.nodes(spark, d), f).select("id", "frequency")


@_query(sql.query((*sql.TEXT_TUPLETS, sql.PAIRS), "SELECT one AS source, two AS target, frequency FROM pairs WHERE one <> two AND frequency >= 3 AND doc_frequency BETWEEN 2 AND 100 AND last_occurrence >= DATE '2024-03-01'"))
def filter_edges(spark, d):
    rows = c.pairs(spark, d).withColumns({"id": F.lit(None), "source": F.col("entity_one"), "target": F.col("entity_two")})
    f = GraphFilter(minimum_edge_frequency=3, minimum_edge_doc_frequency=2, maximum_edge_doc_frequency=100, earliest_date=dt.date(2024, 3, 1))
    return filters.edges(rows, f).select("source", "target", "frequency")


# graphs

_TOP = "top AS (SELECT label FROM entities WHERE frequency >= 2 ORDER BY frequency DESC, label LIMIT 100)"
_TOP_EDGES = "found AS (SELECT one, two, frequency FROM pairs WHERE one <> two AND one IN (SELECT label FROM top) AND two IN (SELECT label FROM top) ORDER BY frequency DESC, one, two LIMIT 200)"


def _graph(spark, d, f=None):
    """Nodes, which the branches of a graph query read several times, and edges, of which it asks no PMI.

    Where several branches read the edges too, ``f`` is given, and those that pass it are written.
    """
    edges = c.as_edges(c.pairs(spark, d))
    return written(c.nodes(spark, d), "nodes"), edges if f is None else written(filters.edges(edges, f), "edges")


@_query(sql.query((*sql.TEXT_COOCS, _TOP, _TOP_EDGES), "SELECT one AS source, two AS target, frequency AS total_frequency FROM found"))
def graph_topk_edges(spark, d):
    return graph.top(*_graph(spark, d), GraphFilter(limit_nodes=100, limit_edges=200, minimum_node_frequency=2))[1].select("source", "target", "total_frequency")


@_query(sql.query((*sql.TEXT_COOCS, _TOP, _TOP_EDGES), "SELECT label AS id, frequency FROM entities WHERE label IN (SELECT one FROM found UNION SELECT two FROM found)"))
def graph_topk_nodes(spark, d):
    return graph.top(*_graph(spark, d), GraphFilter(limit_nodes=100, limit_edges=200, minimum_node_frequency=2))[0].select("id", "frequency")


_GIVEN = ["The", "La", "Of", "And", "That", "De", "Der", "Les", "In", "Is"]
_GIVEN_SQL = ", ".join(f"'{g}'" for g in _GIVEN)


@_query(sql.query(sql.TEXT_COOCS, f"SELECT one AS source, two AS target, frequency AS total_frequency FROM pairs WHERE one <> two AND one IN ({_GIVEN_SQL}) AND two IN ({_GIVEN_SQL}) AND frequency >= 2"))
def graph_subgraph(spark, d):
    return graph.subgraph(*_graph(spark, d), _GIVEN, GraphFilter(minimum_edge_frequency=2, minimum_node_frequency=10**6))[1].select("source", "target", "total_frequency")


_EXPAND = (*sql.TEXT_COOCS, """ok AS (SELECT one, two, frequency FROM pairs WHERE one <> two AND frequency >= 3),
near AS (SELECT two AS label FROM ok WHERE one = 'The' UNION SELECT one FROM ok WHERE two = 'The'),
ids AS (SELECT label FROM near JOIN entities USING (label) WHERE entities.frequency >= 20 UNION SELECT 'The'),
found AS (SELECT * FROM ok WHERE one IN (SELECT label FROM ids) AND two IN (SELECT label FROM ids))""")


@_query(sql.query(_EXPAND, "SELECT one AS source, two AS target, frequency AS total_frequency FROM found"))
def graph_expand(spark, d):
    f = GraphFilter(minimum_edge_frequency=3, minimum_node_frequency=20)
    return graph.expand(*_graph(spark, d, f), ["The"], f)[1].select("source", "target", "total_frequency")


_FOCUS = (*_EXPAND, """few AS (SELECT e.label FROM entities e JOIN ids USING (label) ORDER BY e.label = 'The' DESC, e.frequency DESC, e.label LIMIT 12),
kept AS (SELECT * FROM ok WHERE one IN (SELECT label FROM few) AND two IN (SELECT label FROM few) ORDER BY (one = 'The')::INT + (two = 'The')::INT DESC, frequency DESC, one, two LIMIT 15)""")


@_query(sql.query(_FOCUS, "SELECT one AS source, two AS target, frequency AS total_frequency FROM kept"))
def graph_expand_limits(spark, d):
    f = GraphFilter(minimum_edge_frequency=3, minimum_node_frequency=20, limit_nodes=12, limit_edges=15)
    return graph.expand(*_graph(spark, d, f), ["The"], f)[1].select("source", "target", "total_frequency")


@_query(sql.query(sql.STAR_ALL, """SELECT subject AS source, object AS target, sum(frequency)::BIGINT AS total_frequency,
array_to_string(list_slice(list(predicate ORDER BY round(significance, 9) DESC, predicate), 1, 3), ', ') || CASE WHEN count(*) > 3 THEN ', ...' ELSE '' END AS label
FROM relations WHERE subject <> object GROUP BY subject, object"""))
def relation_edges_grouped(spark, d):
    rows = c.rounded(c.star_edges(spark, d), "significance", digits=9)
    return graph.group_relations(filters.edges(rows, GraphFilter())).select("source", "target", "total_frequency", "label")


@_query(sql.query((*sql.STAR_ALL, sql.ENDS, sql.STAR_ENTITIES, """top AS (SELECT label FROM sentities ORDER BY frequency DESC, label LIMIT 20)"""), """
SELECT subject AS source, object AS target, sum(frequency)::BIGINT AS total_frequency FROM relations
WHERE subject IN (SELECT label FROM top) AND object IN (SELECT label FROM top) GROUP BY ALL"""))
def relation_graph(spark, d):
    n, e = written(c.star_nodes(spark, d), "nodes"), written(c.star_edges(spark, d), "edges")
    return graph.top(n, e, GraphFilter(limit_nodes=20), relations=True)[1].select("source", "target", "total_frequency")


# communities

_COMM = (*sql.TEXT_COOCS, "strong AS (SELECT one AS a, two AS b, pmi AS weight FROM coocs WHERE one <> two AND f1 >= 3 AND f2 >= 3 AND frequency >= 3 AND pmi >= 2.0)", "verts AS (SELECT label AS id FROM entities WHERE frequency >= 3)")
_BOTH = "both_ AS (SELECT a, b FROM strong UNION SELECT b, a FROM strong)"
_REACH = "reach AS (SELECT id, id AS other FROM verts UNION SELECT r.id, s.b FROM reach r JOIN both_ s ON r.other = s.a)"
_MEMBERS = "members AS (SELECT min(other) AS community, id FROM reach GROUP BY id)"
_CF = GraphFilter(minimum_node_frequency=3, minimum_edge_frequency=3)


def _strong(spark, d):
    nodes = written(c.nodes(spark, d), "nodes")
    # the edges are read once, so they aren't written before the filter, which then goes before the joins
    v, e = community.community_graph(nodes, c.as_edges(c.cooccurrences(spark, d, nodes)), _CF, "pmi", 2.0)
    return written(v, "vertices"), written(e, "strong")


@_query(sql.query((*_COMM, _BOTH, _REACH, _MEMBERS), "SELECT community, id FROM members", recursive=True))
def connected_components(spark, d):
    return community.connected(*_strong(spark, d))


_METRICS = """sizes AS (SELECT community, count(*) AS n FROM members GROUP BY community),
marked AS (SELECT s.*, x.community AS ca, y.community AS cb FROM strong s JOIN members x ON x.id = a JOIN members y ON y.id = b),
inner_ AS (SELECT ca AS community, count(*) AS e, avg(weight) AS w FROM marked WHERE ca = cb GROUP BY ca)"""


@_query(sql.query((*_COMM, _BOTH, _REACH, _MEMBERS, _METRICS), """SELECT community, n AS n_members, coalesce(e, 0) AS n_edges, round(CASE WHEN n > 1 THEN coalesce(e, 0) / (n * (n - 1) / 2.0) ELSE 0.0 END, 6)::DOUBLE AS density,
round(coalesce(w, 0.0), 6) AS avg_weight, 0.0::DOUBLE AS conductance, round(CASE WHEN n > 1 THEN coalesce(e, 0) / (n * (n - 1) / 2.0) ELSE 0.0 END, 6)::DOUBLE AS score FROM sizes LEFT JOIN inner_ USING (community)""", recursive=True))
def community_metrics(spark, d):
    v, e = _strong(spark, d)
    return c.rounded(community.metrics(written(community.connected(v, e), "members"), e), "density", "avg_weight", "conductance", "score")


@_query(sql.query((*_COMM, _BOTH), "SELECT x.a || ',' || x.b || ',' || y.b AS members FROM strong x JOIN strong y ON x.b = y.a JOIN strong z ON z.a = x.a AND z.b = y.b"))
def k_cliques(spark, d):
    return community.k_cliques(_strong(spark, d)[1], 3).select(F.array_join("members", ",").alias("members"))


_TRI = """tri AS (SELECT x.a || chr(1) || x.b || chr(1) || y.b AS t, [x.a, x.b, y.b] AS m FROM strong x JOIN strong y ON x.b = y.a JOIN strong z ON z.a = x.a AND z.b = y.b),
side AS (SELECT t, m[1] || chr(1) || m[2] AS f FROM tri UNION ALL SELECT t, m[1] || chr(1) || m[3] FROM tri UNION ALL SELECT t, m[2] || chr(1) || m[3] FROM tri),
link AS (SELECT DISTINCT p.t AS a, q.t AS b FROM side p JOIN side q USING (f)),
span AS (SELECT a AS t, b AS other FROM link UNION SELECT s.t, l.b FROM span s JOIN link l ON s.other = l.a),
named AS (SELECT t, min(other) AS community FROM span GROUP BY t)"""


@_query(sql.query((*_COMM, _TRI), "SELECT DISTINCT community, unnest(m) AS id FROM named JOIN tri USING (t)", recursive=True))
def clique_percolation(spark, d):
    return community.clique_percolation(_strong(spark, d)[1], 3)


@_query()
def louvain(spark, d):
    return community.louvain(*_strong(spark, d), resolution=1.5)


# contexts and lookups

_CTX = """spans AS (SELECT doc_id, cs, ce, count(*) AS c FROM tuplets WHERE one <> two AND one IN ({g}) AND two IN ({g}) GROUP BY ALL),
opened AS (SELECT *, CASE WHEN max(ce) OVER (PARTITION BY doc_id ORDER BY cs, ce ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= cs THEN 0 ELSE 1 END AS new FROM spans),
island AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY cs, ce ROWS UNBOUNDED PRECEDING) AS k FROM opened),
merged AS (SELECT doc_id, min(cs) AS cs, max(ce) AS ce, sum(c)::BIGINT AS n FROM island GROUP BY doc_id, k)""".format(g=_GIVEN_SQL)


@_query(sql.query((*sql.TEXT_TUPLETS, _CTX), "SELECT doc_id, cs AS context_start, substr(text, cs + 1, ce - cs) AS context, n AS n_spans FROM merged JOIN docs USING (doc_id)"))
def contexts_merged(spark, d):
    rows = contexts.between_entities(c.tuplets(spark, d), _GIVEN, "entity_one", "entity_two").select("doc_id", "context_start", "context_end")
    return contexts.with_text(contexts.merged(rows), c.table(spark, d, "documents"))


@_query(sql.query((*sql.TEXT, f"h AS (SELECT doc_id, s, e, label FROM mentions WHERE label IN ({_GIVEN_SQL}))", """pts AS (SELECT doc_id, s AS p FROM h UNION SELECT doc_id, e FROM h UNION SELECT doc_id, 0 FROM docs UNION SELECT doc_id, length(text) FROM docs),
seg AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM pts)"""), """
SELECT seg.doc_id, p AS segment_start, q AS segment_end, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS roles
FROM seg LEFT JOIN h ON h.doc_id = seg.doc_id AND h.s <= p AND h.e >= q WHERE q IS NOT NULL GROUP BY ALL"""))
def text_segments(spark, d):
    h = c.mentions(spark, d).filter(F.col("label").isin(*_GIVEN)).select("doc_id", "span_start", "span_end", F.col("label").alias("role"))
    out = contexts.segments(c.table(spark, d, "documents"), h)
    return out.select("doc_id", "segment_start", "segment_end", F.array_join("roles", ",").alias("roles"))


@_query(sql.query(sql.TEXT_ENTITIES, """SELECT label AS id, frequency, CASE WHEN lower(label) = 'th' THEN 0 WHEN starts_with(lower(label), 'th') THEN 1 ELSE 2 END AS rank
FROM entities WHERE label ILIKE '%th%' ORDER BY rank, frequency DESC, length(label), label LIMIT 50"""))
def entity_search(spark, d):
    return lookup.search(c.nodes(spark, d), "th", 50).select("id", "frequency", "rank")


@_query(sql.query((*sql.TEXT, sql.CHUNKS, sql.PLACED, sql.tuplets()), f"SELECT DISTINCT doc_id FROM tuplets WHERE one IN ({_GIVEN_SQL}) AND two IN ({_GIVEN_SQL})"))
def docs_by_entities(spark, d):
    return lookup.doc_ids_by_entities(c.tuplets(spark, d), _GIVEN)


@_query(sql.query(sql.TEXT, "SELECT DISTINCT doc_id FROM mentions WHERE label = 'The'"))
def docs_by_entity(spark, d):
    return lookup.doc_ids_of(c.mentions(spark, d), F.col("label") == "The")


@_query(sql.query(sql.TEXT, "SELECT doc_id, lang, count(label) AS n_mentions, coalesce(min(s), -1) AS first_start FROM docs LEFT JOIN mentions USING (doc_id) GROUP BY ALL"))
def docs_with_mentions(spark, d):
    out = lookup.with_annotations(c.table(spark, d, "documents").select("doc_id", "lang"), mentions=c.mentions(spark, d).select("doc_id", "span_start", "span_end", "label"))
    return out.select("doc_id", "lang", F.size("mentions").cast("long").alias("n_mentions"), F.coalesce(F.get("mentions", F.lit(0))["span_start"], F.lit(-1)).alias("first_start"))


@_query(sql.query(sql.TEXT_COOCS, "SELECT one AS entity_one, two AS entity_two, frequency, f1 AS entity_one_frequency, f2 AS entity_two_frequency, round(pmi, 6) AS pmi FROM coocs"))
def cooccurrence_table(spark, d):
    out = c.cooccurrences(spark, d, frequencies=True)
    return c.rounded(out.select("entity_one", "entity_two", "frequency", "entity_one_frequency", "entity_two_frequency", "pmi"), "pmi")


# analyses


@_query(sql.query(sql.TEXT, "SELECT label AS span_text, count(*) AS frequency FROM mentions GROUP BY label"))
def mention_frequencies(spark, d):
    return analytics.mention_frequencies(c.mentions(spark, d))


@_query(sql.query(sql.TEXT, "SELECT label FROM mentions GROUP BY label HAVING count(*) = 1"))
def hapax_legomena(spark, d):
    return analytics.hapaxes(c.mentions(spark, d).groupBy("label").agg(F.count("*").alias("frequency"))).select("label")


@_query(sql.query((*sql.TEXT, "f AS (SELECT label, count(*) AS n FROM mentions GROUP BY label), r AS (SELECT ln(n) AS y, ln(row_number() OVER (ORDER BY n DESC, label)) AS x FROM f)"), "SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, count(*) AS n FROM r"))
def zipf_fit(spark, d):
    return c.rounded(analytics.zipf(analytics.mention_frequencies(c.mentions(spark, d))), "slope", "intercept")


@_query(sql.query((*sql.TEXT_COOCS, "both_ AS (SELECT f1, f2, pmi FROM coocs UNION ALL SELECT f2, f1, pmi FROM coocs)"), "SELECT CAST(ceil(log2(f1)) AS INTEGER) AS bin_one, CAST(ceil(log2(f2)) AS INTEGER) AS bin_two, round(avg(pmi), 6) AS avg_pmi, count(*) AS n FROM both_ GROUP BY 1, 2"))
def pmi_heatmap(spark, d):
    return c.rounded(analytics.pmi_heatmap(c.cooccurrences(spark, d, frequencies=True)), "avg_pmi")


_SPIKES = """hits AS (SELECT DISTINCT x.community, t.doc_id FROM tuplets t JOIN members x ON x.id = one JOIN members y ON y.id = two AND y.community = x.community),
found AS (SELECT community, count(*) AS spikes, date_diff('day', min(ts), max(ts)) + 1 AS spread FROM hits JOIN docs USING (doc_id) GROUP BY community)"""


def _spikes(spark, d):
    members = written(community.connected(*_strong(spark, d)), "members")
    return analytics.spikes(members, c.tuplets(spark, d), c.attributes(spark, d))


@_query(sql.query((*_COMM, _BOTH, _REACH, _MEMBERS, _SPIKES), "SELECT community, spikes, CAST(spread AS INTEGER) AS spread FROM found", recursive=True))
def spikes_spread(spark, d):
    return _spikes(spark, d)


@_query(sql.query((*_COMM, _BOTH, _REACH, _MEMBERS, _SPIKES), """SELECT CASE WHEN spikes < 2 THEN 'single' WHEN spread < 8 THEN 'burst' WHEN spread < 31 AND spikes < 8 THEN 'short' WHEN spread < 31 THEN 'short_dense'
WHEN spread < 366 AND spikes < 8 THEN 'long' WHEN spread < 366 THEN 'long_dense' ELSE 'perennial' END AS type, count(*) AS n FROM found GROUP BY 1""", recursive=True))
def typology(spark, d):
    return analytics.typology(_spikes(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


@_query(sql.query((*_COMM, _BOTH, _REACH, _MEMBERS, _SPIKES), "SELECT CAST(floor(log10(spread)) AS INTEGER) AS spread_bin, CAST(floor(log2(spikes)) AS INTEGER) AS spike_bin, count(*) AS n FROM found WHERE spikes > 1 GROUP BY 1, 2", recursive=True))
def spike_heatmap(spark, d):
    return analytics.spike_heatmap(_spikes(spark, d))


@_query(sql.query((*_COMM, _BOTH, _REACH, _MEMBERS, "sizes AS (SELECT community, count(*) AS n FROM members GROUP BY community)"), """SELECT count(*) AS communities, round(avg(n), 6) AS mean_size, min(n) AS min_size, quantile_cont(n, 0.25)::DOUBLE AS q1_size,
quantile_cont(n, 0.5)::DOUBLE AS median_size, quantile_cont(n, 0.75)::DOUBLE AS q3_size, max(n) AS max_size, 1.0::DOUBLE AS memberships FROM sizes""", recursive=True))
def community_sizes(spark, d):
    return c.rounded(analytics.size_summary(community.connected(*_strong(spark, d))), "mean_size")


@_query(sql.query((*sql.TEXT, "f AS (SELECT label, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang = 'fr') AS b FROM mentions JOIN docs USING (doc_id) GROUP BY label)"), """SELECT label, a AS frequency_a, b AS frequency_b, b - a AS change,
CASE WHEN b = 0 THEN 'only_a' WHEN a = 0 THEN 'only_b' ELSE 'shared' END AS side FROM f WHERE a + b > 0"""))
def model_comparison(spark, d):
    m = c.mentions(spark, d).join(c.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    a, b = (m.filter(F.col("lang") == lang).groupBy("label").agg(F.count("*").alias("frequency")) for lang in ("en", "fr"))
    return analytics.compare_models(a, b)


_HALF = (*_COMM, _BOTH, _REACH, _MEMBERS, """strong2 AS (SELECT a, b FROM strong WHERE weight >= 2.5), both2 AS (SELECT a, b FROM strong2 UNION SELECT b, a FROM strong2),
reach2 AS (SELECT id, id AS other FROM verts UNION SELECT r.id, s.b FROM reach2 r JOIN both2 s ON r.other = s.a), members2 AS (SELECT min(other) AS community, id FROM reach2 GROUP BY id),
size_ AS (SELECT community, count(*) AS n FROM members GROUP BY community), k AS (SELECT x.community, y.community AS other, count(*) AS k FROM members x JOIN members2 y USING (id) GROUP BY ALL)""")


@_query(sql.query(_HALF, "SELECT community, n, round(max(k)::DOUBLE / n, 6) AS coverage FROM size_ JOIN k USING (community) GROUP BY community, n", recursive=True))
def coverage_overlaps(spark, d):
    v, e = _strong(spark, d)
    one, two = written(community.connected(v, e), "members"), community.connected(v, e.filter("weight >= 2.5"))
    return c.rounded(analytics.best_overlaps(one, two), "coverage")


@_query(sql.query((*_COMM, _BOTH, _REACH, _MEMBERS, """acts AS (SELECT DISTINCT doc_id, label AS id FROM mentions), size_ AS (SELECT community, count(*) AS n FROM members GROUP BY community),
k AS (SELECT community, doc_id, count(*) AS k FROM acts JOIN members USING (id) GROUP BY ALL)"""), "SELECT community, round(avg(k::DOUBLE / n), 6) AS activation FROM k JOIN size_ USING (community) GROUP BY community", recursive=True))
def activation(spark, d):
    members = written(community.connected(*_strong(spark, d)), "members")
    acts = c.mentions(spark, d).select(F.col("doc_id").alias("context"), F.col("label").alias("id"))
    return c.rounded(contexts.activation(members, acts), "activation")


# extraction rules, exports and lookups


@_query(sql.query(sql.TEXT, "SELECT doc_id, s AS span_start, e AS span_end, label AS span_text FROM mentions WHERE CASE WHEN length(label) > 6 THEN length(label) >= 8 AND length(label) < 12 ELSE length(label) >= 3 END"))
def allowed_entities(spark, d):
    n = F.length("span_text")
    m = extract.mentions(c.documents(spark, d)).withColumns({"n_tokens": n, "is_named": n > 6})
    return extract.allowed_entities(m, named=(8, 12), nouns=(3, None)).select("doc_id", "span_start", "span_end", "span_text")


# clusters of the mentions of a document that begin alike; short ones stand for pronouns
_CLUSTERS = """clusters AS (SELECT doc_id, CAST(ascii(label) AS INTEGER) AS cluster, s, e, label, length(label) <= 3 AS pron FROM mentions),
heads AS (SELECT doc_id, cluster, arg_min({'s': s, 'e': e, 't': label}, {'n': length(label), 's': s}) AS h FROM clusters WHERE NOT pron GROUP BY doc_id, cluster)"""


def _clusters(spark, d):
    m = extract.mentions(c.documents(spark, d))
    return m, m.select("doc_id", F.ascii("span_text").alias("cluster"), "span_start", "span_end", "span_text", (F.length("span_text") <= 3).alias("is_pronoun"))


@_query(sql.query((*sql.TEXT, _CLUSTERS), "SELECT doc_id, cluster, h.s AS head_start, h.e AS head_end, h.t AS head_text FROM heads"))
def antecedents(spark, d):
    return extract.antecedents(_clusters(spark, d)[1])


@_query(sql.query((*sql.TEXT, _CLUSTERS), """SELECT doc_id, s AS span_start, e AS span_end, CASE WHEN pron THEN h.t ELSE label END AS span_text, pron AS is_coref_resolved
FROM clusters LEFT JOIN heads USING (doc_id, cluster) WHERE NOT pron OR h IS NOT NULL"""))
def resolve_pronouns(spark, d):
    return extract.resolve_pronouns(*_clusters(spark, d))


_LEADING = r"""firsts AS (SELECT doc_id, w[1] AS sub, w[2] AS pred, w[3] AS obj, CAST(instr(text, w[1]) - 1 AS INTEGER) AS ss, CAST(instr(text, w[3]) - 1 AS INTEGER) AS os
    FROM (SELECT doc_id, text, regexp_extract_all(text, '\S+') AS w FROM documents) WHERE len(w) >= 3)"""


@_query(sql.query((_LEADING,), "SELECT doc_id, ss AS span_start, CAST(ss + length(sub) AS INTEGER) AS span_end, sub AS span_text FROM firsts UNION SELECT doc_id, os, CAST(os + length(obj) AS INTEGER), obj FROM firsts"))
def triplet_mentions(spark, d):
    return extract.triplet_mentions(extract.leading_triplets(c.documents(spark, d)))


@_query(sql.query((_LEADING, """lab AS (SELECT label, row_number() OVER (ORDER BY label) AS id FROM (SELECT sub AS label FROM firsts UNION SELECT obj FROM firsts)),
    prd AS (SELECT label, row_number() OVER (ORDER BY label) AS id FROM (SELECT DISTINCT pred AS label FROM firsts))"""), """SELECT doc_id, a.id AS subject_entity_id, sub AS subject_label, sub AS subject_span_text, ss AS subject_span_start,
CAST(ss + length(sub) AS INTEGER) AS subject_span_end, p.id AS predicate_id, pred AS predicate_label, pred AS pred_span_text, b.id AS object_entity_id, obj AS object_label, obj AS object_span_text, os AS object_span_start,
CAST(os + length(obj) AS INTEGER) AS object_span_end FROM firsts JOIN lab a ON a.label = sub JOIN lab b ON b.label = obj JOIN prd p ON p.label = pred"""))
def triplet_table(spark, d):
    t = written(extract.leading_triplets(c.documents(spark, d)).withColumns({"subject": F.col("subj_text"), "predicate": F.col("pred_text"), "object": F.col("obj_text")}), "triplets")
    nodes = mapping.ranked_ids(t.select(F.explode(F.array("subject", "object")).alias("label")).distinct(), ["label"])
    return lookup.triplet_table(t, nodes, mapping.ranked_ids(t.select(F.col("predicate").alias("label")).distinct(), ["label"]))


@_query(sql.query((*sql.TEXT_TUPLETS, "lab AS (SELECT label, row_number() OVER (ORDER BY label) AS id FROM (SELECT DISTINCT label FROM mentions))"), """SELECT doc_id, a.id AS entity_one_id, l1 AS entity_one_label, l1 AS entity_one_span_text, s1 AS entity_one_span_start,
e1 AS entity_one_span_end, b.id AS entity_two_id, l2 AS entity_two_label, l2 AS entity_two_span_text, s2 AS entity_two_span_start, e2 AS entity_two_span_end FROM tuplets JOIN lab a ON a.label = l1 JOIN lab b ON b.label = l2"""))
def tuplet_table(spark, d):
    docs = c.documents(spark, d)
    nodes = mapping.ranked_ids(c.mentions(spark, d).select("label").distinct(), ["label"])
    t = cooccur.window_tuplets(docs, 3, ids=nodes).withColumns({"one_label": F.col("one_text"), "two_label": F.col("two_text")})
    return lookup.tuplet_table(t)


@_query(sql.query((*sql.TEXT_ENTITIES, _ATTR), """SELECT e.label AS id, e.label, frequency, doc_frequency, array_to_string(list_sort(list(DISTINCT value) FILTER (name = 'lang')), ',') AS lang,
array_to_string(list_sort(list(DISTINCT value) FILTER (name = 'source')), ',') AS source FROM entities e JOIN mentions m ON m.label = e.label JOIN cats USING (doc_id) GROUP BY e.label, frequency, doc_frequency"""))
def entity_details(spark, d):
    m = c.mentions(spark, d)
    cats = stats.target_categories(m, c.attributes(spark, d), ["label"]).withColumnRenamed("label", "id")
    alt = m.select("label").distinct().withColumn("alt_labels", F.array().cast("array<string>"))
    out = lookup.details(c.nodes(spark, d), cats, alt, stats.STATS)
    return out.select("id", "label", "stats.frequency", "stats.doc_frequency", *[F.array_join(F.element_at("categories", n), ",").alias(n) for n in ("lang", "source")])


@_query(sql.query(sql.TEXT, f"SELECT doc_id, count(DISTINCT label) AS n_matched, array_to_string(list_sort(list(DISTINCT label)), ',') AS matched FROM mentions WHERE label IN ({_GIVEN_SQL}) GROUP BY doc_id ORDER BY n_matched DESC, doc_id LIMIT 50 OFFSET 50"))
def docs_by_focus(spark, d):
    found = lookup.docs_by_focus(c.mentions(spark, d), "label", _GIVEN)
    return lookup.page(found, [F.desc("n_matched"), "doc_id"], 50, 50).select("doc_id", "n_matched", F.array_join("matched", ",").alias("matched"))


@_query(sql.query(sql.TEXT_ENTITIES, "SELECT label AS id, frequency FROM entities WHERE label IN (SELECT DISTINCT label FROM mentions WHERE length(label) <= 5)"))
def nodes_by_many_ids(spark, d):
    ids = [r["label"] for r in c.mentions(spark, d).filter(F.length("label") <= 5).select("label").distinct().collect()]  # as a caller's list
    return lookup.get_multiple(c.nodes(spark, d), ids).select("id", "frequency")


# communities that edges cross: entities by their first letter
_LETTERS = """members AS (SELECT label AS id, substr(label, 1, 1) AS community FROM entities),
sizes AS (SELECT community, count(*) AS n FROM members GROUP BY community),
ed AS (SELECT one AS a, two AS b, CAST(frequency AS DOUBLE) AS weight FROM pairs WHERE one <> two),
crossed AS (SELECT weight, substr(a, 1, 1) AS ca, substr(b, 1, 1) AS cb FROM ed),
inn AS (SELECT ca AS community, count(*) AS e, avg(weight) AS w FROM crossed WHERE ca = cb GROUP BY ca),
cut AS (SELECT community, count(*) AS x FROM (SELECT ca AS community FROM crossed WHERE ca <> cb UNION ALL SELECT cb FROM crossed WHERE ca <> cb) GROUP BY community),
measured AS (SELECT community, n, coalesce(e, 0) AS e, coalesce(w, 0.0) AS w, coalesce(x, 0) AS x, CASE WHEN n > 1 THEN coalesce(e, 0) / (n * (n - 1) / 2.0) ELSE 0.0 END AS density,
    CASE WHEN coalesce(x, 0) + 2 * coalesce(e, 0) > 0 THEN coalesce(x, 0)::DOUBLE / (coalesce(x, 0) + 2 * coalesce(e, 0)) ELSE 0.0 END AS conductance FROM sizes LEFT JOIN inn USING (community) LEFT JOIN cut USING (community))"""


def _lettered(spark, d):
    pairs = c.pairs(spark, d).filter("entity_one <> entity_two").withColumn("weight", F.col("frequency").cast("double"))
    members = c.entities(spark, d).select(F.substring("label", 1, 1).alias("community"), F.col("label").alias("id"))
    return members, pairs.select(F.col("entity_one").alias("a"), F.col("entity_two").alias("b"), "weight")


@_query(sql.query((*sql.TEXT_TUPLETS, sql.ENTITIES, sql.PAIRS, _LETTERS), """SELECT community, n AS n_members, e AS n_edges, round(density, 6)::DOUBLE AS density, round(w, 6)::DOUBLE AS avg_weight, round(conductance, 6) AS conductance,
round(density * (1 - conductance), 6)::DOUBLE AS score FROM measured"""))
def crossed_community_metrics(spark, d):
    return c.rounded(community.metrics(*_lettered(spark, d)), "density", "avg_weight", "conductance", "score")


@_query(sql.query((*sql.TEXT_TUPLETS, sql.ENTITIES, sql.PAIRS, _LETTERS), "SELECT ca AS community, count(*) AS n_edges, sum(weight) AS weight FROM crossed WHERE ca = cb GROUP BY ca"))
def community_inner_edges(spark, d):
    out = community.inner_edges(*_lettered(spark, d))
    return out.select("community", F.size("edges").cast("long").alias("n_edges"), F.aggregate("edges", F.lit(0.0), lambda s, e: s + e["weight"]).alias("weight"))


# labels of one and two words, of which the rankings choose differently: labels of even length also stand, twice as often, after a determiner
_DETERMINERS = ", ".join(f"'{w}'" for w in tx.DETERMINERS)
_PHRASES = f"""phrases AS (SELECT label, lower(label) AS norm, 1 AS words FROM mentions WHERE lower(label) NOT IN ({_DETERMINERS})
    UNION ALL SELECT 'The ' || label, lower(label), 2 FROM mentions, range(2) WHERE length(label) % 2 = 0 AND lower(label) NOT IN ({_DETERMINERS})),
counts AS (SELECT label, norm, words, count(*) AS n FROM phrases GROUP BY ALL)"""


def _phrases(spark, d):
    one = c.mentions(spark, d).select("label").filter(~F.lower("label").isin(*tx.DETERMINERS))
    two = one.filter(F.length("label") % 2 == 0).select(F.concat(F.lit("The "), "label").alias("label"))
    return one.unionByName(two).unionByName(two)


@_query(sql.query((*sql.TEXT, _PHRASES), "SELECT label, first_value(label) OVER (PARTITION BY norm ORDER BY words, n DESC, label) AS canonical FROM counts"))
def normalize_phrases_shortest(spark, d):
    return mapping.normalized(_phrases(spark, d), mapping.lower, "shortest")


@_query(sql.query((*sql.TEXT, _PHRASES), "SELECT label, first_value(label) OVER (PARTITION BY norm ORDER BY n DESC, words, label) AS canonical FROM counts"))
def normalize_phrases_most_frequent(spark, d):
    return mapping.normalized(_phrases(spark, d), mapping.lower, "most_frequent")
