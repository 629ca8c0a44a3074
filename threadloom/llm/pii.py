"""Sanitisation of personal data by the information that terms disclose.

Protected entities (addresses, numbers) are found by patterns and are themselves
generalised to their kind.  Beyond that, a term t discloses an entity c to the
degree PMI(c; t) / IC(c), where IC(c) = -log p(c) is all the information that c
carries: 1 if t occurs only where c does, 0 if they are independent.  Terms from
GENERALISE_FROM on are generalised, from REMOVE_FROM on removed, wherever they
occur in the corpus.

All probabilities come from the whole corpus, copies included: p(c | t) is the
number of contexts of c that hold t by the number of all occurrences of t, and p(c)
the share of the corpus's words that lie in contexts of c.  A context is the WINDOW
words on either side of an occurrence.  Every entity and every term of its contexts
is scored.  Equal contexts (of copied documents) are support only once; a pair that
shares fewer than SUPPORT distinct contexts gets a lower bound: those that it lacks
count as occurrences of the term elsewhere, copied as often as those that it has.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textcode as tc
from .automaton import Rule
from .secrets import LANE_BYTES, Scanner, raw_bytes, scanner

#: Kinds of protected entities; where two overlap, the one that starts first, then the longer, then the earlier here counts.
ENTITIES = (
    Rule("EMAIL", r"[0-9A-Za-z_.+-]+@[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)+"),
    Rule("PHONE", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}"),
    Rule("PHONE", r"\(\d{3}\) ?\d{3}[ .-]\d{4}"),
    Rule("PHONE", r"\d{3}[.-]\d{3}[.-]\d{4}"),
    Rule("IP", r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
    Rule("IP", r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"),
    Rule("IP", r"[0-9A-Fa-f]{4}(?::[0-9A-Fa-f]{1,4}){0,5}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}"),
    Rule("SSN", r"\d{3}-\d{2}-\d{4}"),
    Rule("CARD", r"(?:\d{4}[ -]){3}\d{4}"),
    Rule("NUMBER", r"\d{9,19}"),
    Rule("IBAN", r"[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?"),
)

#: Contexts from which on a pair's share is taken as it is, and the least that an entity and a pair must have to be scored (1: all are).
WINDOW, SUPPORT, MIN_SUPPORT = 8, 3, 1
GENERALISE_FROM, REMOVE_FROM = 0.85, 0.95
#: What a disclosing term is generalised to.
GENERAL = "[TERM]"
#: Terms that are broadcast at a time; more are worked through in slices.
SLICE_TERMS = 4_000_000

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    for a, b in tc.slices(column, LANE_BYTES):
        part = pc.fill_null(column.slice(a, b - a), "")
        data, off = raw_bytes(part)
        yield a, b, data, off, part


def entities(raw: bytes, mask: int, rules: tuple[Rule, ...], scan: Scanner | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the protected entities of a text, in order and without overlap."""
    scan = scan or scanner(rules)
    found = [(s, -e, k) for k in range(len(rules)) if mask >> k & 1 for s, e in scan.spans(k, raw)]
    out: list[tuple[int, int, str]] = []
    for s, e, k in sorted(found):
        if not out or s >= out[-1][1]:
            out.append((s, -e, rules[k].name))
    return out


def _hashes(words: list[bytes]) -> np.ndarray:
    """Hashes as textcode has them, of single words."""
    return tc.Words(pa.array([w.decode("utf-8", "replace") for w in words], pa.string())).hash if words else np.zeros(0, np.uint64)


def contexts(docs: DataFrame, rules: tuple[Rule, ...] = ENTITIES, window: int = WINDOW) -> DataFrame:
    """(entity, context, terms): hashes of every entity occurrence, of its context, and of the context's distinct terms."""

    known = docs.sparkSession.sparkContext.broadcast(scanner(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = known.value
        for batch in batches:
            for _, _, data, off, _ in _texts(batch.column(0)):
                ent, ctx, terms = [], [], []
                masks = scan.masks(data, off)
                for i in np.flatnonzero(masks).tolist():
                    raw = data[off[i] : off[i + 1]].tobytes()
                    spans = entities(raw, int(masks[i]), rules, scan)
                    starts = [s for s, _, _ in spans]
                    words = []
                    for m in _WORD.finditer(raw):
                        k = bisect_left(starts, m.end()) - 1
                        if k < 0 or spans[k][1] <= m.start():
                            words.append((m.start(), m[0]))
                    code = _hashes([w for _, w in words])
                    at = [p for p, _ in words]
                    for s, e, _ in spans:
                        k = bisect_left(at, s)
                        near = code[max(0, k - window) : k + window]
                        value = re.sub(rb"[^0-9a-z\x80-\xff@]", b"", raw[s:e].lower())
                        ent.append(int.from_bytes(hashlib.sha1(value).digest()[:8], "big", signed=True))
                        ctx.append(int(np.cumsum(tc.mix(near + np.arange(len(near)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))[-1:].view(np.int64)[0]) if len(near) else 0)
                        terms.append(np.unique(near).view(np.int64).tolist())
                if ent:
                    yield pa.RecordBatch.from_arrays([pa.array(ent, pa.int64()), pa.array(ctx, pa.int64()), pa.array(terms, pa.list_(pa.int64()))], ["entity", "context", "terms"])

    return docs.select("text").filter("text IS NOT NULL").mapInArrow(run, "entity long, context long, terms array<long>")


def occurrences(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, n): partial numbers of occurrences of the given sorted hashes; term null counts all words."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        count, total = np.zeros(len(own), np.int64), 0
        for batch in batches:
            for a, b in tc.slices(batch.column(0)):
                h = tc.Words(batch.column(0).slice(a, b - a)).hash
                total += len(h)
                at = np.minimum(np.searchsorted(own, h), len(own) - 1)
                count += np.bincount(at[own[at] == h], minlength=len(own))
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *own[seen].view(np.int64).tolist()], pa.int64()), pa.array([total, *count[seen].tolist()], pa.int64())], ["term", "n"]
        )

    return docs.select("text").filter("text IS NOT NULL").mapInArrow(run, "term long, n long")


def _slices(terms: DataFrame, size: int) -> Iterator[np.ndarray]:
    """The distinct hashes of the column ``term``, sorted, at most ``size`` at a time."""
    count = terms.count()
    parts = max(1, -(-count // size))
    for k in range(parts if count else 0):
        part = terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == k) if parts > 1 else terms
        yield np.sort(part.select("term").toArrow()["term"].to_numpy().astype(np.int64).view(np.uint64))


def disclosure(docs: DataFrame, rules: tuple[Rule, ...] = ENTITIES, window: int = WINDOW, min_support: int = MIN_SUPPORT, least: float = GENERALISE_FROM, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """(term, score): the terms whose greatest disclosure of any entity is at least ``least``.

    With ``min_support`` above 1, entities and pairs of fewer contexts are left out.
    """
    ctx = shared.written(contexts(docs, rules, window), "pii-contexts").groupBy("entity", "context").agg(F.count("*").alias("copies"), F.first("terms").alias("terms"))
    known = ctx.groupBy("entity").agg(F.sum("copies").alias("n_c"), F.count("*").alias("support")).filter(F.col("support") >= min_support).drop("support")
    pairs = ctx.join(known, "entity").select("entity", "n_c", "copies", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "n_c", "term").agg(F.sum("copies").alias("n_ct"), F.count("*").alias("support"))
    pairs = shared.written(pairs.filter(F.col("support") >= min_support), "pii-pairs")
    counts = None
    for terms in _slices(pairs.select("term").distinct(), slice_terms):
        part = occurrences(docs, terms)
        # the number of all words comes with every slice and is the same each time
        part = part.groupBy("term").agg(F.sum("n").alias("n"))
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        return pairs.select("term", F.lit(1.0).alias("score"))
    counts = shared.written(counts, "pii-counts")
    total = counts.filter("term IS NULL").agg(F.max("n").alias("words"))
    p_c = F.least(F.lit(1.0), F.col("n_c") * F.lit(2 * window) / F.col("words"))
    lacking = F.greatest(F.lit(0), F.lit(SUPPORT) - F.col("support")) * F.col("n_ct") / F.col("support")
    p_ct = F.least(F.lit(1.0), F.col("n_ct") / (F.col("n") + lacking))
    score = F.when(p_c >= 1.0, F.lit(0.0)).otherwise(1 - F.ln(p_ct) / F.ln(p_c))
    # total is one row
    scored = pairs.join(counts.filter("term IS NOT NULL"), "term").crossJoin(F.broadcast(total)).select("term", score.alias("score"))
    return shared.written(scored.groupBy("term").agg(F.max("score").alias("score")).filter(F.col("score") >= least), "pii-terms")


_SCHEMA = "doc_id long, text string, n_entities int, n_generalised int, n_removed int"


def _replace(raw: bytes, cuts: list[tuple[int, int, bytes]]) -> str:
    out, at = [], 0
    for s, e, put in sorted(cuts):
        out += [raw[at:s], put]
        at = e
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def sanitise(docs: DataFrame, rules: tuple[Rule, ...] = ENTITIES, window: int = WINDOW, min_support: int = MIN_SUPPORT, generalise_from: float = GENERALISE_FROM, remove_from: float = REMOVE_FROM, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """(doc_id, text, n_entities, n_generalised, n_removed) of every row, with the sanitised text.

    Entities become their kind in brackets, such as ``[EMAIL]``; terms that disclose
    entities become ``[TERM]`` or, with the white space after them, vanish.  Null
    texts stay null and empty ones empty, with counts of 0; repeated rows are
    sanitised alike; other columns are ignored.
    """

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off, part in _texts(batch.column(1)):
                scan = known.value
                masks = scan.masks(data, off)
                count = np.zeros(b - a, np.int32)
                texts = batch.column(1).slice(a, b - a)
                if masks.any():
                    changed = texts.to_pylist()
                    for i in np.flatnonzero(masks).tolist():
                        raw = data[off[i] : off[i + 1]].tobytes()
                        spans = entities(raw, int(masks[i]), rules, scan)
                        count[i] = len(spans)
                        if spans:
                            changed[i] = _replace(raw, [(s, e, f"[{kind}]".encode()) for s, e, kind in spans])
                    texts = pa.array(changed, pa.string())
                zero = pa.array(np.zeros(b - a, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), texts, pa.array(count), zero, zero], ["doc_id", "text", "n_entities", "n_generalised", "n_removed"])

    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(scanner(rules))
    terms = disclosure(docs, rules, window, min_support, generalise_from, slice_terms)
    pairs = itertools.zip_longest(
        _slices(terms.filter(F.col("score") < remove_from), slice_terms), _slices(terms.filter(F.col("score") >= remove_from), slice_terms), fillvalue=np.zeros(0, np.uint64)
    )
    steps = [_drop_terms(sc.broadcast(pair)) for pair in pairs]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return steps[0](hide(batches)) if steps else hide(batches)

    # one Python worker hides and drops; only further slices of terms take another
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, _SCHEMA)
    for step in steps[1:]:
        out = out.mapInArrow(step, _SCHEMA)
    return out


_KINDS = re.compile(rb"\[(?:" + b"|".join(sorted({r.name.encode() for r in ENTITIES} | {b"TERM"})) + rb")\]")


def _within(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _drop_terms(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, lost = held.value
        for batch in batches:
            for a, b in tc.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                w = tc.Words(part.column(1))
                rows = np.unique(np.searchsorted(w.off, np.flatnonzero(_within(terms, w.hash) | _within(lost, w.hash)), side="right") - 1)
                texts, general, removed = part.column(1), part.column(3).to_numpy().copy(), part.column(4).to_numpy().copy()
                if len(rows):
                    changed = texts.to_pylist()
                    for i in rows.tolist():
                        raw = changed[i].encode("utf-8", "surrogatepass")
                        labels = [m.span() for m in _KINDS.finditer(raw)]
                        words = [m for m in _WORD.finditer(raw) if not any(s <= m.start() < e for s, e in labels)]
                        cuts = []
                        code = _hashes([m[0] for m in words])
                        for m, gone, general_term in zip(words, _within(lost, code), _within(terms, code)):
                            if gone:
                                end = m.end()
                                while end < len(raw) and raw[end] in b" \t":
                                    end += 1
                                cuts.append((m.start(), end, b""))
                                removed[i] += 1
                            elif general_term:
                                cuts.append((m.start(), m.end(), GENERAL.encode()))
                                general[i] += 1
                        changed[i] = _replace(raw, cuts)
                    texts = pa.array(changed, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), texts, part.column(2), pa.array(general), pa.array(removed)], ["doc_id", "text", "n_entities", "n_generalised", "n_removed"])

    return run
