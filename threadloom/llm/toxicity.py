"""Toxicity grades by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from . import textcode as tc

#: Bounds on the labelled rows, (clean, toxic), that the model is fitted on.
MAX_ROWS = (9000, 3000)
#: Grades beside 0: toxic rows are divided by how dense their marked terms are.
TOXIC_GRADES = 2
#: Expected severity from which a document is rejected.
REJECT_FROM = 0.3
#: Strength of the penalty on weights; steps of gradient descent.
PENALTY, STEPS = 1e-5, 300
#: A feature is used if its likelihood ratio statistic is above the square of this, as a normal deviate.
SIGNIFICANT = 3.5


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade > k) = sigmoid(w.x - cuts[k]): one weight vector for all ordered cuts."""

    weights: np.ndarray
    cuts: np.ndarray

    def exceed(self, score: np.ndarray) -> np.ndarray:
        return _sigmoid(score[:, None] - self.cuts[None, :])

    def expected(self, score: np.ndarray) -> np.ndarray:
        """Sum over k of P(grade > k), which is the mean grade."""
        return self.exceed(score).sum(1)


def fit_cumulative_link(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, size: int, steps: int = STEPS, penalty: float = PENALTY) -> OrdinalModel:
    """Full-batch maximum likelihood (Adam); cuts stay ordered as a first cut plus positive gaps."""
    used, feature = np.unique(feature, return_inverse=True)
    n, k = len(grade), max(1, int(grade.max(initial=1)))
    w = np.zeros(len(used))
    first, gaps = np.zeros(1), np.zeros(k - 1)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, first, gaps)]
    for t in range(1, steps + 1):
        score = np.bincount(row, value * w[feature], minlength=n)
        cuts = first[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        above = _sigmoid(score[:, None] - cuts[None, :])
        full = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        p = np.maximum(full[at, grade] - full[at, grade + 1], 1e-12)
        slope = full * (1 - full)
        d_score = (slope[at, grade] - slope[at, grade + 1]) / p / n
        d_cut = np.zeros((n, k + 2))
        d_cut[at, grade] -= slope[at, grade] / p / n
        d_cut[at, grade + 1] += slope[at, grade + 1] / p / n
        d_cuts = d_cut[:, 1:-1].sum(0)
        g_w = np.bincount(feature, value * d_score[row], minlength=len(used)) - penalty * w
        g_first = np.array([d_cuts.sum()])
        g_gaps = np.exp(gaps) * np.cumsum(d_cuts[::-1])[::-1][1:]
        for param, grad, (m, v) in zip((w, first, gaps), (g_w, g_first, g_gaps), state):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            param += 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return OrdinalModel(weights, first[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]))


def grades_of(row: np.ndarray, feature: np.ndarray, toxic: np.ndarray, words: np.ndarray, levels: int = TOXIC_GRADES) -> np.ndarray:
    """Ordered grades from 0/1 labels.

    Clean rows have grade 0.  Toxic rows have grades 1 to ``levels`` by quantile of
    their marked features a word; a feature is marked if it is at least 20 times as
    frequent among toxic rows as among clean ones.
    """
    size = int(feature.max(initial=0)) + 1
    bad = np.bincount(feature[toxic[row] == 1], minlength=size)
    good = np.bincount(feature[toxic[row] == 0], minlength=size)
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    marked = (bad >= 5) & ((bad + 0.5) / n_bad > 20 * (good + 0.5) / n_good)
    density = np.bincount(row, marked[feature], minlength=len(toxic)) / np.maximum(words, 1)
    grade = np.zeros(len(toxic), np.int64)
    if toxic.any():
        own = density[toxic == 1]
        limits = np.quantile(own, np.arange(1, levels) / levels)
        grade[toxic == 1] = 1 + np.searchsorted(limits, own, side="left")
    return grade


def significant(row: np.ndarray, feature: np.ndarray, toxic: np.ndarray, size: int, least: float = SIGNIFICANT) -> np.ndarray:
    """Which features occur in at least 5 rows and at rates that surely differ between the classes (likelihood ratio)."""
    bad = np.bincount(feature[toxic[row] == 1], minlength=size).astype(float)
    good = np.bincount(feature[toxic[row] == 0], minlength=size).astype(float)
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    rate = (bad + good) / (n_bad + n_good)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))

    ratio = 2 * (part(bad, n_bad * rate) + part(good, n_good * rate) + part(n_bad - bad, n_bad * (1 - rate)) + part(n_good - good, n_good * (1 - rate)))
    return (ratio > least**2) & (bad + good >= 5)


def _featurised(labelled: DataFrame) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tc.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                row, feature, value, sizes = features.sparse(part.column(1))
                off = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(off, pa.array(feature)), pa.ListArray.from_arrays(off, pa.array(value)), pa.array(sizes.astype(np.int64))],
                    ["toxic", "feature", "value", "words"],
                )

    return labelled.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(code, "toxic int, feature array<int>, value array<float>, words long")


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int] = MAX_ROWS) -> DataFrame:
    """(toxic, text) of at most ``max_rows`` labelled documents, clean and toxic.

    The rows of least hash of their doc_id are taken, so the sample is spread over
    the corpus and the same in every run.  Null ids and null labels are left out.
    """
    label = F.when(F.col("toxic") > 0, 1).when(F.col("toxic") == 0, 0)
    known = labels.select("doc_id", label.alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows[c]) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    # at most sum(max_rows) rows of two numbers: a bounded broadcast
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")


def train(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int] = MAX_ROWS) -> OrdinalModel:
    """Fit on the bounded sample; without labels of both classes, or terms that tell them apart, every score is 0 and nothing is toxic."""
    got = _featurised(training_rows(docs, labels, max_rows)).toArrow().combine_chunks()
    toxic = got["toxic"].to_numpy().astype(np.int64) if got.num_rows else np.zeros(0, np.int64)
    size = 1 << features.BITS
    if not (toxic == 1).any() or not (toxic == 0).any():
        return OrdinalModel(np.zeros(size, np.float32), np.array([40.0] * TOXIC_GRADES))
    lists = got["feature"].combine_chunks()
    feature = lists.flatten().to_numpy()
    value = got["value"].combine_chunks().flatten().to_numpy()
    row = np.repeat(np.arange(len(toxic)), lists.value_lengths().to_numpy())
    grade = grades_of(row, feature, toxic, got["words"].to_numpy())
    keep = significant(row, feature, toxic, size)[feature]
    if not keep.any():
        return OrdinalModel(np.zeros(size, np.float32), np.array([40.0] * TOXIC_GRADES))
    row, feature, value = row[keep], feature[keep], value[keep]
    return fit_cumulative_link(row, feature, value, grade, size)


def _scorer(spark, model: OrdinalModel):
    shared = spark.sparkContext.broadcast((model.weights, model.cuts))

    def scored(column: pa.Array) -> np.ndarray:
        weights, cuts = shared.value
        out = []
        for a, b in tc.slices(column):
            row, feature, value, _ = features.sparse(column.slice(a, b - a))
            out.append(np.bincount(row, value * weights[feature], minlength=b - a))
        score = np.concatenate(out) if out else np.zeros(0)
        return OrdinalModel(weights, cuts).exceed(score)

    return scored


def severity(docs: DataFrame, model: OrdinalModel, reject_from: float = REJECT_FROM) -> DataFrame:
    """(doc_id, grade, expected_severity, toxic) of every row.

    ``grade`` is the most probable grade, ``expected_severity`` the mean grade, and
    ``toxic`` tells whether it reaches ``reject_from``.  A null or empty text has the
    score of no features; a repeated row is scored again; other columns are ignored.
    """
    scored = _scorer(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = scored(batch.column(1))
            full = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            grade = (full[:, :-1] - full[:, 1:]).argmax(1) if len(above) else np.zeros(0, np.int64)
            mean = above.sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(grade.astype(np.int32)), pa.array(mean), pa.array(mean >= reject_from)],
                ["doc_id", "grade", "expected_severity", "toxic"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, grade int, expected_severity double, toxic boolean")


def keep_clean(docs: DataFrame, model: OrdinalModel, reject_from: float = REJECT_FROM) -> DataFrame:
    """``docs`` without the rows whose expected severity reaches ``reject_from``; a map, without a shuffle."""
    scored = _scorer(docs.sparkSession, model)

    @F.arrow_udf("double")
    def mean(texts: pa.Array) -> pa.Array:
        return pa.array(scored(texts).sum(1))

    return docs.filter(mean("text") < reject_from)
