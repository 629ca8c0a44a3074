"""Column expressions on text: mentions, chunks and their pairing, all inside the JVM and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are stripped from both ends of a token.
STRIPPED = ".,!?;:"
#: Between chunks: sentence ends with the white space after them, and line ends.
BOUNDARY = r"[.!?]+\s*|\n+"

_MENTION = "array<struct<span_start:int,span_end:int,span_text:string>>"


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


#: Elements that a fold takes at a time: appending copies an array, so one array for all would cost the square of a text's elements.
BLOCK = 1024


def _blocks(array: str) -> str:
    """The elements of an array expression, which is computed once, in arrays of BLOCK."""
    return f"""transform(array({array}), xs -> transform(sequence(0, cast(ceil(greatest(size(xs), 1) / {BLOCK}) AS INT) - 1), b -> slice(xs, b * {BLOCK} + 1, {BLOCK})))[0]"""


def folded(array: str, kind: str, item: str, width: str, wanted: str) -> str:
    """SQL: an array of ``item`` (of type ``kind``) for the elements p of ``array`` that are ``wanted``.

    ``item`` may use acc.at, the sum of ``width`` over the elements before p.
    """
    return f"""aggregate({_blocks(array)},
        named_struct('at', 0, 'outs', cast(array() AS array<{kind}>)),
        (done, block) -> aggregate(block,
            named_struct('at', done.at, 'out', cast(array() AS {kind})),
            (acc, p) -> named_struct('at', acc.at + {width}, 'out', if({wanted}, array_append(acc.out, {item}), acc.out)),
            acc -> named_struct('at', acc.at, 'outs', if(size(acc.out) = 0, done.outs, array_append(done.outs, acc.out)))),
        done -> flatten(done.outs))"""


def pieces(text: str, pattern: str) -> str:
    """SQL: structs (piece, gap) of the text between the matches of a pattern and the match that follows."""
    return f"zip_with(split({text}, '{_sql(pattern)}'), regexp_extract_all({text}, '({_sql(pattern)})', 1), (c, g) -> named_struct('piece', c, 'gap', g))"


_PIECE_WIDTH = "length(p.piece) + coalesce(length(p.gap), 0)"


def matches(text: str, pattern: str) -> Column:
    """array<struct<span_start, span_end, span_text>>: all matches of a pattern."""
    item = "named_struct('span_start', acc.at + length(p.piece), 'span_end', acc.at + length(p.piece) + length(p.gap), 'span_text', p.gap)"
    return F.expr(folded(pieces(text, pattern), _MENTION, item, _PIECE_WIDTH, "p.gap IS NOT NULL"))


def capitalized_mentions(text: str = "text") -> Column:
    """array<struct<span_start, span_end, span_text>>: tokens whose stripped form begins with an upper-case letter.

    Tokens are parted by white space.  A span starts where its token starts, also
    where leading punctuation was stripped, and has the length of the stripped form.
    """
    # the text is cut before such tokens only, so the fold has one step for each mention, not for each word
    start = "[" + STRIPPED + "]*\\\\p{Lu}"
    word = f"trim(BOTH '{STRIPPED}' FROM regexp_extract(p, '^\\\\S+', 0))"
    item = f"named_struct('span_start', acc.at, 'span_end', acc.at + length({word}), 'span_text', {word})"
    return F.expr(folded(f"split({text}, '(?<!\\\\S)(?={start})')", _MENTION, item, "length(p)", f"p RLIKE '^{start}'"))


def chunk_bounds(text: str = "text", boundary: str = BOUNDARY) -> Column:
    """array<struct<chunk_start, chunk_end>>: the text between boundary matches, empty chunks dropped."""
    item = "named_struct('chunk_start', acc.at, 'chunk_end', acc.at + length(p.piece))"
    return F.expr(folded(pieces(text, boundary), "array<struct<chunk_start:int,chunk_end:int>>", item, _PIECE_WIDTH, "length(p.piece) > 0"))


def mentions_in_chunks(mentions: str = "mentions", chunks: str = "chunks") -> Column:
    """struct<placed, before>: the mentions that lie fully inside a chunk, with its number, and how many precede each chunk.

    One sweep over both lists in order of their starts; mentions that straddle a
    boundary or lie in a gap are dropped.
    """
    event = "array<struct<at:int,kind:int,until:int,number:int,label:string>>"
    placed = "array<struct<chunk:int,span_start:int,span_end:int,span_text:string>>"
    events = f"""sort_array(cast(concat(
        transform({chunks}, (c, i) -> named_struct('at', c.chunk_start, 'kind', 0, 'until', c.chunk_end, 'number', i, 'label', '')),
        transform({mentions}, m -> named_struct('at', m.span_start, 'kind', 1, 'until', m.span_end, 'number', -1, 'label', m.span_text))) AS {event}))"""
    return F.expr(
        f"""aggregate({_blocks(events)},
            named_struct('chunk', -1, 'until', -1, 'n', 0, 'placed', cast(array() AS array<{placed}>), 'before', cast(array() AS array<array<int>>)),
            (done, block) -> aggregate(block,
                named_struct('chunk', done.chunk, 'until', done.until, 'placed', cast(array() AS {placed}), 'before', cast(array() AS array<int>)),
                (acc, e) -> if(e.kind = 0,
                    named_struct('chunk', e.number, 'until', e.until, 'placed', acc.placed, 'before', array_append(acc.before, done.n + size(acc.placed))),
                    if(e.until <= acc.until,
                        named_struct('chunk', acc.chunk, 'until', acc.until,
                            'placed', array_append(acc.placed, named_struct('chunk', acc.chunk, 'span_start', e.at, 'span_end', e.until, 'span_text', e.label)),
                            'before', acc.before),
                        acc)),
                acc -> named_struct('chunk', acc.chunk, 'until', acc.until, 'n', done.n + size(acc.placed),
                    'placed', array_append(done.placed, acc.placed), 'before', array_append(done.before, acc.before))),
            done -> named_struct('placed', flatten(done.placed), 'before', flatten(done.before)))"""
    )


def window_pairs(window: int, swept: str = "swept", chunks: str = "chunks") -> Column:
    """Pairs of placed mentions of chunk i with later ones of chunks i to i + window, and their context.

    The context reaches from the start of chunk i to the end of the last chunk of
    its window, for every pair that is found from chunk i.
    """
    return F.expr(
        f"""flatten(transform({swept}.placed, (m, j) -> transform(
            slice({swept}.placed, j + 2, greatest(0, coalesce(get({swept}.before, m.chunk + {window} + 1), size({swept}.placed)) - j - 1)),
            p -> named_struct(
                'one_start', m.span_start, 'one_end', m.span_end, 'one_text', m.span_text,
                'two_start', p.span_start, 'two_end', p.span_end, 'two_text', p.span_text,
                'context_start', {chunks}[m.chunk].chunk_start,
                'context_end', {chunks}[least(m.chunk + {window}, size({chunks}) - 1)].chunk_end))))"""
    )


def determinerless(label: Column) -> Column:
    """The label without its determiners (a closed list); the label itself if nothing else is left."""
    words = F.filter(F.split(label, " "), lambda w: ~F.lower(w).isin(*DETERMINERS))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(label)


DETERMINERS = (
    "a", "an", "the", "this", "that", "these", "those", "every", "each", "either", "neither", "some", "any", "no", "another", "all", "both",
)


def rank_key(label: Column, frequency: Column, by: str) -> Column:
    """What the canonical label of a cluster has most of: see ``operators.mapping``."""
    short = -F.size(F.split(label, " "))
    # code points, negated: the first in the alphabet wins, and of a label and its beginning the longer
    letters = F.transform(F.split(label, ""), lambda c: -F.ascii(c))
    if by == "shortest":
        return F.struct(short.alias("a"), frequency.cast("long").alias("b"), letters.alias("c"))
    if by == "most_frequent":
        return F.struct(frequency.cast("long").alias("a"), short.alias("b"), letters.alias("c"))
    raise ValueError(f"unknown ranking: {by}")
