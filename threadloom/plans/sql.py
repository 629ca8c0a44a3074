"""DuckDB building blocks: the same corpora, written independently of the Spark operators."""

from __future__ import annotations

DOCS = """docs AS (SELECT doc_id, text, lang, source, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS ts, CAST(doc_id AS INTEGER) AS ord FROM documents)"""

# tokens with their offsets by a running sum of lengths
MENTIONS = r"""pieces AS (
    SELECT doc_id, k, p[k] AS t FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k
        FROM (SELECT doc_id, regexp_extract_all(text, '\s+|\S+') AS p FROM documents))),
placed AS (SELECT doc_id, t, trim(t, '.,!?;:') AS label, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM pieces),
mentions AS (SELECT DISTINCT doc_id, CAST(off AS INTEGER) AS s, CAST(off + length(label) AS INTEGER) AS e, label FROM placed WHERE regexp_matches(label, '^\p{Lu}'))"""

CHUNKS = r"""cuts AS (
    SELECT doc_id, k, p[k] AS t FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS k
        FROM (SELECT doc_id, regexp_extract_all(text, '[.!?]+\s*|\n+|[^.!?\n]+') AS p FROM documents))),
laid AS (SELECT doc_id, k, t, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM cuts),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk, CAST(off AS INTEGER) AS cs, CAST(off + length(t) AS INTEGER) AS ce
    FROM laid WHERE NOT regexp_matches(t, '^[.!?\n]'))"""

PLACED = """inside AS (SELECT m.*, c.chunk FROM mentions m JOIN chunks c ON m.doc_id = c.doc_id AND m.s >= c.cs AND m.e <= c.ce)"""


def tuplets(window: int = 3) -> str:
    return f"""lasts AS (SELECT doc_id, max(chunk) AS last FROM chunks GROUP BY doc_id),
tuplets AS MATERIALIZED (
    SELECT a.doc_id, a.s AS s1, a.e AS e1, a.label AS l1, b.s AS s2, b.e AS e2, b.label AS l2, f.cs, g.ce, least(a.label, b.label) AS one, greatest(a.label, b.label) AS two
    FROM inside a JOIN inside b ON a.doc_id = b.doc_id AND ((a.chunk = b.chunk AND b.s > a.s) OR (b.chunk > a.chunk AND b.chunk <= a.chunk + {window}))
    JOIN lasts z ON z.doc_id = a.doc_id JOIN chunks f ON f.doc_id = a.doc_id AND f.chunk = a.chunk
    JOIN chunks g ON g.doc_id = a.doc_id AND g.chunk = least(a.chunk + {window}, last))"""


def stats(name: str, source: str, keys: str, docs: str = "docs") -> str:
    return f"""{name} AS (
    SELECT {keys}, count(*) AS frequency, count(DISTINCT a.doc_id) AS doc_frequency,
        (count(*) - 1) * ((SELECT count(*) FROM {docs})::DOUBLE / (count(DISTINCT a.doc_id) + 1)) AS adjusted_tf_idf,
        min(ts) AS first_occurrence, max(ts) AS last_occurrence, min(ord) AS first_occurrence_ordinal, max(ord) AS last_occurrence_ordinal
    FROM {source} a JOIN {docs} d ON a.doc_id = d.doc_id GROUP BY {keys})"""


ENTITIES = stats("entities", "mentions", "label")
PAIRS = stats("pairs", "tuplets", "one, two")
PMI = """coocs AS (SELECT p.*, a.frequency AS f1, b.frequency AS f2, log10(p.frequency) + log10((SELECT sum(frequency) FROM entities)) - log10(a.frequency) - log10(b.frequency) AS pmi
    FROM pairs p JOIN entities a ON a.label = one JOIN entities b ON b.label = two)"""

STAR_DOCS = """sdocs AS (SELECT o_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS ts, CAST(o_orderkey AS INTEGER) AS ord, o_orderpriority AS priority, o_orderstatus AS status FROM orders)"""
STAR = """triplets AS (
    SELECT l_orderkey AS doc_id, c_mktsegment AS subject, l_returnflag AS predicate, p_brand AS object
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""
PREDICATES = stats("predicates", "triplets", "predicate", "sdocs")
RELATIONS = stats("relations0", "triplets", "subject, predicate, object", "sdocs")
SIGNIFICANCE = """relations AS (SELECT r.*, log10(r.frequency) - log10(sum(r.frequency) OVER (PARTITION BY subject, object)) - log10(p.frequency) + log10((SELECT sum(frequency) FROM predicates)) AS significance
    FROM relations0 r JOIN predicates p USING (predicate))"""
ENDS = """ends AS (SELECT doc_id, subject AS label FROM triplets UNION ALL SELECT doc_id, object FROM triplets)"""
STAR_ENTITIES = stats("sentities", "ends", "label", "sdocs")
OCCURRENCE = "first_occurrence, last_occurrence, first_occurrence_ordinal, last_occurrence_ordinal"
STATS = f"frequency, doc_frequency, round(adjusted_tf_idf, 6) AS adjusted_tf_idf, {OCCURRENCE}"

TEXT = (DOCS, MENTIONS)
TEXT_ENTITIES = (*TEXT, ENTITIES)
TEXT_TUPLETS = (*TEXT, CHUNKS, PLACED, tuplets())
TEXT_COOCS = (*TEXT_TUPLETS, ENTITIES, PAIRS, PMI)
STAR_ALL = (STAR_DOCS, STAR, PREDICATES, RELATIONS, SIGNIFICANCE)


def query(parts: tuple[str, ...], select: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + select
