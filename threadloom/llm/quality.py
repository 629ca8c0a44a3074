"""Document quality by Bradley-Terry pairwise ranking."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textcode as tc

#: Bounds on the labelled rows, (low, high), that the model is fitted on; all their preference pairs are used.
MAX_ROWS = (3000, 6000)
#: Weight of the penalty, and the least number of steps of the fit.
PENALTY, STEPS = 1e-3, 400
#: Scores that are sorted in one place to find a quantile.
SORTED_SCORES = 100_000

FEATURES = (
    "log_words", "upper_share", "digit_share", "symbol_share", "stop_share", "space_share", "non_ascii_share",
    "mean_word", "short_words", "distinct_share", "top_word_share", "same_as_last", "words_a_line", "repeated_lines",
)

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"!#$%&*+/<=>@[\\]^_`{|}~",
    "stop": b".,;:?\"'()-",
    "space": b" \t\r\n\f",
    "other": bytes(range(128, 256)),
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _KINDS.items()}


def dense(column: pa.Array) -> np.ndarray:
    """FEATURES of every text; all 0 for a null or empty one."""
    filled = pc.fill_null(column, "")
    texts = filled.to_pylist()
    w = tc.Words(filled)
    n = len(texts)
    sizes = np.diff(w.off)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    length = np.maximum(np.diff(off), 1)

    def total(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        t = np.concatenate([[0], np.cumsum(flags)])
        return (t[bounds[1:]] - t[bounds[:-1]]).astype(np.float64)

    share = {k: total(t[data], off) / length for k, t in _TABLES.items()}
    words = np.maximum(sizes, 1)
    widths = w.end - w.start
    rows = np.repeat(np.arange(n), sizes)
    values, bounds = tc.distinct(w.hash, w.off)
    order = np.lexsort((w.hash, rows))
    h, r = w.hash[order], rows[order]
    edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.zeros(0, np.int64)
    top = np.zeros(n)
    if len(edge):
        np.maximum.at(top, r[edge], np.diff(np.append(edge, len(h))))
    again = np.concatenate([[False], (w.hash[1:] == w.hash[:-1]) & (rows[1:] == rows[:-1])]) if len(h) else np.zeros(0, bool)
    lines = pc.split_pattern(filled, "\n")
    n_lines = np.maximum(pc.list_value_length(lines).to_numpy(), 1)
    flat = lines.flatten()
    codes = flat.dictionary_encode().indices.to_numpy().astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    owner = pc.list_parent_indices(lines).to_numpy()
    kinds = np.unique(owner.astype(np.int64) << 32 | codes) >> 32
    out = np.stack(
        [
            np.log1p(sizes), share["upper"], share["digit"], share["symbol"], share["stop"], share["space"], share["other"],
            total(widths, w.off) / words, total(widths <= 3, w.off) / words, np.diff(bounds) / words, top / words, total(again, w.off) / words,
            np.log1p(sizes / n_lines), 1 - np.bincount(kinds, minlength=n) / n_lines,
        ],
        axis=1,
    )
    out[np.diff(off) == 0] = 0
    return out


def _expanded(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.clip(x, -6, 6) ** 2], axis=1)


@dataclass(frozen=True)
class Ranker:
    """score = w . (standardised features and their squares)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return _expanded((x - self.mean) / self.scale) @ self.weights


def _fit(x: np.ndarray, differences: Callable[[np.ndarray, int], np.ndarray], steps: int, penalty: float) -> Ranker:
    """Logistic loss on differences of features (better less worse) by Adam; ``differences`` gives those of a step."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = _expanded((x - mean) / scale)
    w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for t in range(1, steps + 1):
        d = differences(z, t - 1)
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        g = d.T @ p / len(d) - penalty * w
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        w += 0.05 / math.sqrt(1 + 9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Ranker(mean, scale, w)


def fit_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> Ranker:
    """P(a over b) = sigmoid(score(a) - score(b)), for given pairs of rows."""
    return _fit(x, lambda z, _: z[better] - z[worse], steps, penalty)


def fit_sides(x: np.ndarray, high: np.ndarray, low: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> Ranker:
    """The same for all pairs of a row of ``high`` over one of ``low``.

    A step takes every row of the larger side, each with the row that stands some
    places on in the smaller side, so a round of as many steps as the smaller side
    has rows sees every pair once.  At least one round is made, and ``steps`` steps.
    """
    sign = 1.0 if len(high) >= len(low) else -1.0
    long, short = (high, low) if sign > 0 else (low, high)
    rng = np.random.default_rng(0)
    turns = np.concatenate([rng.permutation(len(short)) for _ in range(-(-max(steps, len(short)) // len(short)))])
    at = np.arange(len(long))
    return _fit(x, lambda z, t: sign * (z[long] - z[short[(at + turns[t]) % len(short)]]), len(turns), penalty)


def train(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int] = MAX_ROWS) -> Ranker:
    """Fit on all preference pairs (a high-quality row over a low-quality one) among at most ``max_rows`` labelled rows.

    The rows of least hash of their doc_id are taken, so the sample is spread over
    the corpus and the same in every run.  Without labels of both kinds all scores
    are 0.
    """
    label = F.when(F.col("quality") > 0, 1).when(F.col("quality") == 0, 0)
    known = labels.select("doc_id", label.alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    parts = [known.filter(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows[c]) for c in (0, 1)]
    # at most sum(max_rows) rows of two numbers: a bounded broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(parts[0].unionByName(parts[1])), "doc_id")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tc.slices(batch.column(2)):
                part = batch.slice(a, b - a)
                x = dense(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "text").mapInArrow(code, "doc_id long, quality int, x array<double>").toArrow().combine_chunks().sort_by("doc_id")
    quality = got["quality"].to_numpy() if got.num_rows else np.zeros(0)
    high, low = np.flatnonzero(quality == 1), np.flatnonzero(quality == 0)
    k = len(FEATURES)
    if not len(high) or not len(low):
        return Ranker(np.zeros(k), np.ones(k), np.zeros(2 * k))
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, k)
    return fit_sides(x, high, low)


def kth_smallest(df: DataFrame, column: str, k: int, sorted_rows: int = SORTED_SCORES) -> float | None:
    """The k-th smallest value, from 1, of a column without nulls; exact, None if there are fewer.

    Approximate quantiles close in on it, and counts below and above them make
    sure that it stays inside, until ``sorted_rows`` values at most are left to sort.
    """
    value = F.col(column)
    low, high, count = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if not 1 <= k <= count:
        return None
    below = 0  # values under ``low``
    while low < high and count > sorted_rows:
        share, rows = (k - below) / count, df.filter((value >= low) & (value <= high))
        a, b = rows.agg(F.percentile_approx(value, F.array(F.lit(max(0.0, share - 0.01)), F.lit(min(1.0, share + 0.01))), F.lit(1000))).first()[0]
        under, upto = rows.agg(F.count(F.when(value < a, 1)), F.count(F.when(value <= b, 1))).first()
        if below + under < k <= below + upto and (a, b) != (low, high):
            low, high, below, count = a, b, below + under, upto - under
        else:  # heavy ties: the value is one of the bounds, or between them lies less
            if k <= below + under:
                high, count = df.filter((value >= low) & (value < a)).agg(F.max(value), F.count(value)).first()
            elif k > below + upto:
                low, count, below = *df.filter((value > b) & (value <= high)).agg(F.min(value), F.count(value)).first(), below + upto
            else:
                break
    if low == high:
        return low
    rows = df.filter((value >= low) & (value <= high)).groupBy(value.alias("v")).agg(F.count("*").alias("n")).orderBy("v").toLocalIterator()
    for r in rows:
        below += r["n"]
        if below >= k:
            return r["v"]
    return None


def scores(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, score) of every row; a map."""
    held = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tc.slices(batch.column(1)):
                x = dense(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(held.value.score(x))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def rank(docs: DataFrame, labels: DataFrame, quantile: float | None = None, ranker: Ranker | None = None) -> DataFrame:
    """(doc_id, score, kept) of every row: kept from the given quantile of all scores upward.

    Without ``quantile`` the share of low-quality documents among all labelled ones
    is taken (0, which keeps all, if there are none).  Scores equal to the cut are
    kept.  Null and empty texts are scored as texts without any feature; repeated
    rows are scored and counted again; other columns are ignored.
    """
    if quantile is None:
        quantile = labels.filter("quality IS NOT NULL").agg(F.avg(F.when(F.col("quality") > 0, 0.0).otherwise(1.0))).first()[0] or 0.0
    scored = shared.written(scores(docs, ranker or train(docs, labels)), "quality-scores")
    cut = kth_smallest(scored, "score", max(1, math.ceil(quantile * scored.count() - 1e-9)))
    return scored.select("doc_id", "score", (F.col("score") >= F.lit(cut)).alias("kept"))
