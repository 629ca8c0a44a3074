"""DuckDB twins of the queries that SQL can express."""

from .licenses import TEMPLATES, THRESHOLD
from .secrets import RULES

SQL: dict[str, str] = {}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL["op1_secret_scan"] = " UNION ALL ".join(
    f"""
SELECT doc_id, {_quoted(r.name)} AS rule, CAST(i AS INTEGER) AS hit, CAST(length(m[i]) AS INTEGER) AS n_chars, sha256(m[i]) AS fingerprint
FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, {_quoted(r.re2())}, 1) AS m FROM documents WHERE text IS NOT NULL))
"""
    for r in RULES
)

SQL["op7_exact_dedup"] = """
SELECT doc_id, kept_id, n_copies, n_bytes FROM (
    SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id,
           count(*) OVER (PARTITION BY text) AS n_copies,
           CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes
    FROM documents WHERE text IS NOT NULL)
WHERE n_copies > 1
"""

#: Words of the documents, as textcode has them.
_WORDS = r"""
words AS (
    SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
"""

SQL["op10_jaccard_join"] = f"""
WITH RECURSIVE {_WORDS},
grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3
        THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
        ELSE [array_to_string(ws, ' ')] END) AS gram
    FROM words WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS k
    FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id),
pairs AS MATERIALIZED (
    SELECT doc_a, doc_b, CAST(k AS DOUBLE) / (x.n + y.n - k) AS jaccard
    FROM shared JOIN sizes x ON x.doc_id = doc_a JOIN sizes y ON y.doc_id = doc_b
    WHERE k >= 0.5 * (x.n + y.n - k)),
ends AS (SELECT doc_a AS doc_id, doc_b AS other, jaccard FROM pairs UNION ALL SELECT doc_b, doc_a, jaccard FROM pairs),
reached AS (
    SELECT doc_id, other FROM ends
    UNION
    SELECT r.doc_id, e.other FROM reached r JOIN ends e ON e.doc_id = r.other),
classes AS (SELECT doc_id, min(other) AS class_id FROM reached GROUP BY doc_id)
SELECT doc_id, class_id, least(doc_id, coalesce(min(other) FILTER (jaccard = 1.0), doc_id)) AS set_id,
       count(*) AS n_links, max(jaccard) AS closest
FROM ends JOIN classes USING (doc_id) GROUP BY doc_id, class_id
"""

_BIGRAMS = r"""CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END"""

SQL["op8_license_scan"] = rf"""
WITH templates AS (
    SELECT * FROM (VALUES {", ".join(f"({k}, {_quoted(n)}, {_quoted(t)})" for k, (n, t) in enumerate(TEMPLATES))}) v(t_id, license, text)),
passages AS (
    SELECT doc_id, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)
    UNION ALL
    SELECT doc_id, unnest(bs) FROM (SELECT doc_id, string_split_regex(text, '\n[ \t\r]*\n') AS bs FROM documents WHERE text IS NOT NULL) WHERE len(bs) > 1
    UNION ALL
    SELECT doc_id, text FROM documents WHERE contains(text, chr(10))),
numbered AS (SELECT row_number() OVER () AS p_id, doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS ws FROM passages),
p_grams AS (SELECT DISTINCT p_id, doc_id, unnest({_BIGRAMS}) AS gram FROM numbered WHERE len(ws) > 0),
p_sizes AS (SELECT p_id, count(*) AS n FROM p_grams GROUP BY p_id),
t_words AS (SELECT t_id, license, regexp_extract_all(lower(text), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS ws FROM templates),
t_grams AS (SELECT DISTINCT t_id, license, unnest({_BIGRAMS}) AS gram FROM t_words),
t_sizes AS (SELECT t_id, count(*) AS n FROM t_grams GROUP BY t_id),
shared AS (SELECT p_id, doc_id, t_id, license, count(*) AS k FROM p_grams JOIN t_grams USING (gram) GROUP BY ALL),
scored AS (
    SELECT p_id, doc_id, license, max(2.0::DOUBLE * k / (p.n + t.n)) AS dice
    FROM shared JOIN p_sizes p USING (p_id) JOIN t_sizes t USING (t_id) GROUP BY ALL)
SELECT doc_id, license, max(dice) AS dice, CAST(count(*) AS INTEGER) AS n_passages
FROM scored WHERE dice >= {THRESHOLD} GROUP BY doc_id, license
""".replace("\\", "\\")

SQL["op5_warc"] = """
SELECT page_id, url, html, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, 'ok' AS status, true AS verified
FROM pages WHERE html IS NOT NULL
"""
