"""Triplets from dependency parses.

Parses come as a table of tokens, one row each: (doc_id, sent_id, i, start, end,
text, pos, dep, head), with ``head`` the position of the head (a root is its own
head), and a table of noun chunks (doc_id, sent_id, start_i, end_i), end exclusive.
A column ``ent`` of the tokens may hold the kind of a named entity.  A sentence is
a small tree, so the rules run in Python; sentences are packed into rows, which
both tables' shuffle on (doc_id, sent_id) brings together, and worked through by
the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREPOSITIONS = frozenset(("of", "in", "at", "from", "with", "by", "for", "on", "about", "into", "to"))
TRIPLET = "doc_id long, subj_start int, subj_end int, subj_text string, pred_start int, pred_end int, pred_text string, obj_start int, obj_end int, obj_text string"


@dataclass(frozen=True)
class Token:
    i: int
    start: int
    end: int
    text: str
    pos: str
    dep: str
    head: int
    ent: str = ""


@dataclass(frozen=True)
class Allowed:
    """Which chunks may be entities: all, none, or those of low <= tokens < high (None: no bound).

    ``named`` is for chunks all of whose tokens are of a named entity, ``nouns`` for the others.
    """

    named: bool | tuple[int, int | None] = True
    nouns: bool | tuple[int, int | None] = True

    def __call__(self, n_tokens: int, is_named: bool) -> bool:
        rule = self.named if is_named else self.nouns
        if isinstance(rule, tuple):
            return rule[0] <= n_tokens and (rule[1] is None or n_tokens < rule[1])
        return rule


@dataclass
class Sentence:
    tokens: dict[int, Token]
    chunks: list[tuple[int, int]]
    allowed: Allowed = Allowed()
    below: dict[int, list[Token]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for t in sorted(self.tokens.values(), key=lambda t: t.i):
            if t.head != t.i:
                self.below.setdefault(t.head, []).append(t)

    def children(self, i: int) -> list[Token]:
        return self.below.get(i, [])

    def may_be_entity(self, chunk: tuple[int, int]) -> bool:
        return self.allowed(chunk[1] - chunk[0], all(self.tokens[k].ent for k in range(*chunk)))

    def is_pronoun(self, chunk: tuple[int, int]) -> bool:
        return all(self.tokens[k].pos == "PRON" for k in range(*chunk))

    def chunk_of(self, i: int) -> tuple[int, int] | None:
        """The allowed chunk that token i is in; it may be a pronoun."""
        return next((c for c in self.chunks if c[0] <= i < c[1] and self.may_be_entity(c)), None)

    def chunk_head(self, chunk: tuple[int, int]) -> Token:
        inside = range(*chunk)
        return next(self.tokens[k] for k in inside if self.tokens[k].head not in inside or self.tokens[k].head == k)


@dataclass(frozen=True)
class Constructs:
    """Which constructions give triplets."""

    direct: bool = True
    prepositional: bool = True
    passive: bool = True
    copula: bool = True
    conjuncts: bool = True
    noun_prepositions: bool = True


def verb_triplets(s: Sentence, use: Constructs = Constructs()) -> list[tuple]:
    """Triplets (subject chunk, predicate token, object chunk) of the root verb and its conjuncts, then of noun phrases."""
    root = next((t for t in sorted(s.tokens.values(), key=lambda t: t.i) if t.dep == "ROOT"), None)
    verbs, queue = [], [root] if root else []
    while queue:
        v = queue.pop(0)
        verbs.append(v)
        if use.conjuncts:
            queue += [c for c in s.children(v.i) if c.dep == "conj" and c.pos in ("VERB", "AUX")]
    out = []
    for v in verbs:
        subject = _subject(s, v)
        if subject is None and v is not root:
            subject = _subject(s, root)
        found, passive = [], False
        for c in s.children(v.i):
            if c.dep == "dobj" and use.direct:
                found.append((0, c))
            elif c.dep == "prep" and c.i > v.i and use.prepositional:
                found += [(3, p) for p in s.children(c.i) if p.dep == "pobj"][:1]
            elif c.dep == "agent" and use.passive:
                passive = True
                found += [(1, p) for p in s.children(c.i) if p.dep == "pobj"][:1]
            elif c.dep in ("attr", "acomp") and use.copula:
                found.append((2, c))
        chunks = [(rank, s.chunk_of(t.i)) for rank, t in found]
        chunks = sorted(((r, c) for r, c in chunks if c), key=lambda x: x[0])
        # a pronoun is found like any chunk and then takes its triplet with it: no other subject or object steps in
        if subject and chunks and not s.is_pronoun(subject) and not s.is_pronoun(obj := chunks[0][1]):
            out.append((obj, v, subject) if passive else (subject, v, obj))
    if use.noun_prepositions:
        for chunk in s.chunks:
            if s.is_pronoun(chunk) or not s.may_be_entity(chunk):
                continue
            for prep in s.children(s.chunk_head(chunk).i):
                if prep.dep == "prep" and prep.text.lower() in PREPOSITIONS:
                    for p in s.children(prep.i):
                        other = s.chunk_of(p.i) if p.dep == "pobj" else None
                        if other and other != chunk and not s.is_pronoun(other):
                            out.append((chunk, prep, other))
    return out


def _subject(s: Sentence, verb: Token) -> tuple[int, int] | None:
    for c in s.children(verb.i):
        if c.dep in ("nsubj", "nsubjpass") and s.chunk_of(c.i):
            return s.chunk_of(c.i)
    return None


@dataclass(frozen=True)
class PathPattern:
    """Dependency labels up from the first entity to the common ancestor and down to the second.

    The ancestor must be one of ``top`` parts of speech.  ``predicate`` names its
    tokens: the ancestor, the first one "below" it, or "both"; with ``words``, the
    first one below must be among them.
    """

    name: str
    up: tuple[str, ...]
    top: tuple[str, ...]
    down: tuple[str, ...]
    predicate: str = "ancestor"
    swap: bool = False
    words: frozenset[str] | None = None


_VERB, _NOUN = ("VERB", "AUX"), ("NOUN", "PROPN")
PATTERNS = (
    PathPattern("svo", ("nsubj",), _VERB, ("dobj",)),
    PathPattern("copula", ("nsubj",), _VERB, ("attr",)),
    PathPattern("sv_prep_o", ("nsubj",), _VERB, ("prep", "pobj"), "both"),
    PathPattern("svo_conj", ("nsubj",), _VERB, ("conj", "dobj"), "below"),
    PathPattern("sv_conj_prep_o", ("nsubj",), _VERB, ("conj", "prep", "pobj"), "below"),
    PathPattern("passive", ("nsubjpass",), _VERB, ("agent", "pobj"), swap=True),
    PathPattern("np_prep", (), _NOUN, ("prep", "pobj"), "below", words=PREPOSITIONS),
)


def ancestors(s: Sentence, i: int) -> list[int]:
    """The token and all its heads up to the root."""
    out = [i]
    while s.tokens[out[-1]].head != out[-1] and s.tokens[out[-1]].head in s.tokens:
        out.append(s.tokens[out[-1]].head)
    return out


def path(s: Sentence, a: int, b: int) -> tuple[list[int], int, list[int]]:
    """Tokens from a up to below the lowest common ancestor, the ancestor, and from below it down to b."""
    up, other = ancestors(s, a), ancestors(s, b)
    common = next(x for x in up if x in set(other))
    return up[: up.index(common)], common, other[: other.index(common)][::-1]


def pair_triplets(s: Sentence, entities: list[tuple[int, int]], patterns: tuple[PathPattern, ...] = PATTERNS, max_tokens: int = 60, max_distance: int = 10) -> list[tuple]:
    """Triplets of all pairs of entities whose dependency path has one of the patterns; the first that fits counts."""
    if len(s.tokens) > max_tokens:
        return []
    out = set()
    for x in entities:
        for y in entities:
            a, b = s.chunk_head(x).i, s.chunk_head(y).i
            if x == y or abs(a - b) > max_distance:
                continue
            up, top, down = path(s, a, b)
            labels = tuple(s.tokens[k].dep for k in up), tuple(s.tokens[k].dep for k in down)
            for p in patterns:
                if labels != (p.up, p.down) or s.tokens[top].pos not in p.top:
                    continue
                if p.words is not None and s.tokens[down[0]].text.lower() not in p.words:
                    continue
                tokens = {"ancestor": (top,), "below": (down[0],), "both": (top, down[0])}[p.predicate]
                out.add((y, tokens, x) if p.swap else (x, tokens, y))
                break
    return sorted(out, key=lambda t: (t[0], t[1], t[2]))


def _span(s: Sentence, chunk: tuple[int, int]) -> tuple[int, int, str]:
    own = [s.tokens[k] for k in range(*chunk)]
    text, at = "", own[0].start
    for t in own:
        text += " " * (t.start - at) + t.text
        at = t.end
    return own[0].start, own[-1].end, text


def _rows(doc_id: int, s: Sentence, found: list[tuple]) -> list[tuple]:
    out = []
    for subject, predicate, obj in found:
        tokens = [s.tokens[k] for k in predicate] if isinstance(predicate, tuple) else [predicate]
        out.append((doc_id, *_span(s, subject), tokens[0].start, tokens[-1].end, " ".join(t.text for t in tokens), *_span(s, obj)))
    return sorted(out, key=lambda r: (r[1], r[4], r[7]))


def _by_sentence(tokens: DataFrame, chunks: DataFrame, find: Callable[[Sentence], list[tuple]], allowed: Allowed) -> DataFrame:
    keys = ["doc_id", "sent_id"]
    ent = F.coalesce("ent", F.lit("")) if "ent" in tokens.columns else F.lit("")
    words = tokens.groupBy(*keys).agg(F.collect_list(F.struct("i", "start", "end", "text", "pos", "dep", "head", ent.alias("ent"))).alias("words"))
    nouns = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_i", "end_i"))).alias("nouns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, own, chunked in zip(batch["doc_id"], batch["words"], batch["nouns"]):
                s = Sentence({w["i"]: Token(**w) for w in own}, [(c["start_i"], c["end_i"]) for c in chunked], allowed)
                rows += _rows(int(doc_id), s, find(s))
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in TRIPLET.split(",")])

    return words.join(nouns, keys).select("doc_id", "words", "nouns").mapInPandas(run, TRIPLET)


def dependency_triplets(tokens: DataFrame, chunks: DataFrame, use: Constructs = Constructs(), allowed: Allowed = Allowed()) -> DataFrame:
    """Triplets by the verb rules."""
    return _by_sentence(tokens, chunks, lambda s: verb_triplets(s, use), allowed)


def entity_pair_triplets(tokens: DataFrame, chunks: DataFrame, patterns: tuple[PathPattern, ...] = PATTERNS, max_tokens: int = 60, max_distance: int = 10, allowed: Allowed = Allowed()) -> DataFrame:
    """Triplets by path patterns between all pairs of chunks that may be entities and aren't pronouns."""

    def find(s: Sentence) -> list[tuple]:
        return pair_triplets(s, [c for c in s.chunks if s.may_be_entity(c) and not s.is_pronoun(c)], patterns, max_tokens, max_distance)

    return _by_sentence(tokens, chunks, find, allowed)


def extractable(tokens: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that aren't made of pronouns only."""
    inside = (F.col("t.doc_id") == F.col("c.doc_id")) & (F.col("t.sent_id") == F.col("c.sent_id")) & (F.col("t.i") >= F.col("c.start_i")) & (F.col("t.i") < F.col("c.end_i"))
    keys = ["c.doc_id", "c.sent_id", "c.start_i", "c.end_i"]
    return tokens.alias("t").join(chunks.alias("c"), inside).groupBy(*keys).agg(F.bool_and(F.col("t.pos") == "PRON").alias("pronouns")).filter("NOT pronouns").drop("pronouns")
