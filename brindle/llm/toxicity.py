"""Severity of toxic language by a cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w.x - theta_k) with one weight vector for all thresholds, theta_1 < theta_2 < ...; the expected
severity is the sum of these probabilities. x marks which words (runs of letters and digits, A-Z folded, hashed to
``BUCKETS``) stand in a text. Weights carry an L1 penalty, so a word without a tie to the grades weighs nothing.

Fitting uses a bounded sample of labelled rows: at most ``rows_a_grade`` of each grade, in the order of a hash of the id
(documented bound), and of their words the ``features`` with the largest chi-square. Only these counts and the sample's
marks reach the driver. Every row is scored.

Defined results: a null or empty text has no features and gets the severity of its intercepts. Without two grades to
learn from, severity is the only grade known (0 if none). Repeated label rows count once, with the highest grade; rows
with a null id or grade are never learned from. Repeated documents repeat; no rows give none; clashing columns come
back as ``<name>_in``. Memory follows a slice of an Arrow batch and the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import textbatch as tb
from brindle.llm.common import sampled, small, table, written
from brindle.llm.worker import tidy

BUCKETS = 1 << 20
FEATURES = 4_096
ROWS_A_GRADE = 8_000
L1 = 1e-4
#: Sampled rows that a word must stand in to be a feature.
LEAST_ROWS = 3


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct words of each text of a slice."""
    w = tb.words(column, breaks=tb.NOT_ALNUM)
    key = np.unique(w.row.astype(np.int64) * BUCKETS + (w.hash >> np.uint64(44)).astype(np.int64))
    return key // BUCKETS, key % BUCKETS


@dataclass(frozen=True)
class Ordinal:
    """grades in order; buckets (sorted) and their weights; one threshold a grade but the lowest."""

    grades: tuple[int, ...]
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, column: pa.Array) -> np.ndarray:
        """P(grade >= k) for each text and each grade above the lowest."""
        z = np.zeros(len(column))
        if len(self.buckets):
            row, bucket = features(column)
            at = np.minimum(np.searchsorted(self.buckets, bucket), len(self.buckets) - 1)
            hit = self.buckets[at] == bucket
            z = np.bincount(row[hit], self.weights[at[hit]], minlength=len(column))
        return _sigmoid(z[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def loss(w: np.ndarray, theta: np.ndarray, grade: np.ndarray, row: np.ndarray, feature: np.ndarray, l1: float) -> float:
    """Mean negative log likelihood and the penalty."""
    z = np.bincount(row, w[feature], minlength=len(grade))
    padded = np.concatenate([[-np.inf], theta, [np.inf]])
    between = _sigmoid(z - padded[grade]) - _sigmoid(z - padded[grade + 1])
    return float(-np.log(np.maximum(between, 1e-12)).mean() + l1 * np.abs(w).sum())


def fit(grade: np.ndarray, row: np.ndarray, feature: np.ndarray, n_features: int, n_grades: int, *, l1: float = L1, steps: int = 4_000, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated proximal gradient; ``row``/``feature`` mark the ones of the design matrix.

    Thresholds are free parameters beside the weights. The step is one over the largest curvature, found by power iteration
    (the second derivative in z is at most 1/2); a step that raises the loss restarts the momentum. It ends when the loss
    falls by less than ``tolerance`` of itself in ten steps, at the latest after ``steps``."""
    n = len(grade)
    share = np.clip([(grade >= k).mean() for k in range(1, n_grades)], 1e-4, 1 - 1e-4)
    theta = -np.log(share / (1 - share))
    w = np.zeros(n_features)
    v = np.random.default_rng(5).random(n_features) + 0.1
    norm = 1.0
    for _ in range(30):  # of X'X / n
        v = np.bincount(feature, np.bincount(row, v[feature], minlength=n)[row], minlength=n_features) / n
        norm = float(np.linalg.norm(v))
        if norm == 0:
            break
        v /= norm
    rate = 1.0 / (0.5 * norm + 1.0)  # thresholds add at most 1: two a row, each with curvature 1/2
    at_w, at_t, t = w.copy(), theta.copy(), 1.0
    best = before = loss(w, theta, grade, row, feature, l1)
    for step in range(steps):
        z = np.bincount(row, at_w[feature], minlength=n)
        padded = np.concatenate([[-np.inf], at_t, [np.inf]])
        above, below = _sigmoid(z - padded[grade]), _sigmoid(z - padded[grade + 1])
        slope = above + below - 1
        new_w = at_w - rate * np.bincount(feature, slope[row], minlength=n_features) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * l1, 0)
        between = np.maximum(above - below, 1e-12)
        at_theta = np.bincount(grade, above * (1 - above) / between, minlength=n_grades + 1)
        at_theta += np.bincount(grade + 1, -below * (1 - below) / between, minlength=n_grades + 1)
        new_t = np.maximum.accumulate(at_t - rate * at_theta[1:n_grades] / n + 1e-9 * np.arange(n_grades - 1))
        now = loss(new_w, new_t, grade, row, feature, l1)
        if now > best:
            at_w, at_t, t = w.copy(), theta.copy(), 1.0
            if now - best < tolerance * best:
                break
            best = np.inf
            continue
        next_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at_w = new_w + (t - 1) / next_t * (new_w - w)
        at_t = np.maximum.accumulate(new_t + (t - 1) / next_t * (new_t - theta))
        w, theta, t, best = new_w, new_t, next_t, now
        if step % 10 == 9:
            if before - now < tolerance * abs(now):
                break
            before = now
    return w, theta


@tidy
def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = tb.as_strings(batch.column(1))
        for a, b in tb.slices(column):
            row, bucket = features(column.slice(a, b - a))
            bounds = np.searchsorted(row, np.arange(b - a + 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(bucket, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["grade", "marks"])


def learn(docs: DataFrame, labels: DataFrame, grade: Column, *, id_col: str = "doc_id", text_col: str = "text", rows_a_grade: int = ROWS_A_GRADE, features_kept: int = FEATURES, least_rows: int = LEAST_ROWS) -> Ordinal:
    """The regression fitted to ``labels`` (id and ``grade``, an integer column over it) and their texts in ``docs``. Words of
    fewer than ``least_rows`` sampled rows are no features."""
    graded = labels.select(F.col(id_col).alias("_id"), grade.cast("int").alias("grade")).where("_id is not null and grade is not null")
    graded = graded.groupBy("_id").agg(F.max("grade").alias("grade"))
    chosen = sampled(graded, "grade", "_id", rows_a_grade)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(small(chosen), "_id").select("grade", "_text")
    sample = written(rows.mapInArrow(_feature_batches, "grade int, marks array<int>"), "toxicity")
    sizes = {r["grade"]: r["count"] for r in sample.groupBy("grade").count().collect()}
    grades = tuple(sorted(sizes))
    if len(grades) < 2:
        return Ordinal(grades or (0,), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    total, low = sum(sizes.values()), sizes[grades[0]]
    seen = sample.select("grade", F.explode("marks").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.count(F.when(F.col("grade") > grades[0], 1)).alias("k"))
    expected = F.col("n") * (1 - low / total)
    chi = (F.col("k") - expected) ** 2 / (expected * (low / total) * (1 - F.col("n") / (total + 1.0)))
    top = seen.where(F.col("n") >= least_rows).orderBy(chi.desc(), "bucket").limit(features_kept).select("bucket").toArrow()["bucket"].to_numpy()
    buckets = np.sort(top)
    kept = sample.select("grade", F.array_intersect("marks", F.array(*map(F.lit, map(int, buckets)))).alias("marks")) if len(buckets) <= 64 else sample.mapInArrow(_marks_of(buckets), sample.schema)
    found = kept.toArrow()
    marks = found["marks"].combine_chunks()
    y = np.searchsorted(grades, found["grade"].to_numpy())
    lengths = np.diff(marks.offsets.to_numpy())
    feature = np.searchsorted(buckets, marks.flatten().to_numpy())
    w, theta = fit(y, np.repeat(np.arange(len(y)), lengths), feature, len(buckets), len(grades))
    used = w != 0
    return Ordinal(grades, buckets[used].astype(np.int64), w[used], theta)


def _marks_of(buckets: np.ndarray):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            hit = np.isin(values, buckets)
            offsets = np.searchsorted(row[hit], np.arange(len(lists) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[hit], pa.int32()))], names=batch.schema.names)

    return run


RESULTS = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType())])


def _score_batches(text_at: int, model: Ordinal):
    grades = np.array(model.grades)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = tb.as_strings(batch.column(text_at))
            parts = [model.at_least(column.slice(a, b - a)) for a, b in tb.slices(column)]
            p = np.concatenate(parts) if parts else np.zeros((0, len(model.thresholds)))
            severity = grades[0] + p @ np.diff(grades)
            grade = grades[(p >= 0.5).sum(axis=1)]
            first = p[:, 0] if p.shape[1] else np.zeros(len(p))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(severity), pa.array(grade, pa.int32()), pa.array(first)], names=[*batch.schema.names, *RESULTS.fieldNames()])

    return run


def score(df: DataFrame, model: Ordinal, *, text_col: str = "text") -> DataFrame:
    """``df`` with the expected severity, the median grade and the probability of a grade above the lowest."""
    df = df.withColumnsRenamed({c: f"{c}_in" for c in df.columns if c in RESULTS.fieldNames()})
    df = df.withColumn(text_col, df[text_col].cast("string"))
    return df.mapInArrow(_score_batches(df.columns.index(text_col), model), T.StructType([*df.schema.fields, *RESULTS.fields]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = learn(docs, labels, F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)))
    scored = score(docs, model)
    return scored.select("doc_id", F.round("severity", 6).alias("severity"), "grade", F.round("p_toxic", 6).alias("p_toxic"), (F.col("p_toxic") >= 0.5).alias("toxic"))


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
