"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has its mean and a covariance shrunk towards its diagonal and towards the pooled one; the Cholesky factors
are computed once and sent to the executors. The score is the logistic of the difference of the two Mahalanobis log
densities plus the log prior odds.

The fit needs only sums, so it takes all labelled rows, not a sample: every task adds up x and x x' for its rows.

Defined cases: null and empty texts have zero statistics and a score like any other; with no labels, or labels of one
class only, the score is the share of label 1 (0.5 with none); repeated documents each get a row, and a document with
several labels counts once for each; labels other than 0 and 1 and null labels are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chaffsieve.llm._common import written
from chaffsieve.llm.stats import FEATURES, document_stats

#: Shrinkage towards the pooled covariance, towards the diagonal, and the floor added to each variance.
POOLED, DIAGONAL, FLOOR = 0.1, 0.05, 1e-3
#: A score of at least this predicts label 1.
CUT = 0.3
_D = len(FEATURES)
#: Features are shares but for these.
_PLAIN = np.array([f.startswith("log_") or f in ("word_length", "line_words") for f in FEATURES])


def transformed(x: np.ndarray) -> np.ndarray:
    """Square roots spread out the small shares; logarithms and lengths are scaled to about the same range."""
    return np.where(_PLAIN, np.clip(x, 0, 60) / 4, np.sqrt(np.clip(x, 0, 4)))


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of both classes, and the log prior odds of class 1."""

    means: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    odds: float
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = transformed(x)
        density = [
            -0.5 * (((z - self.means[c]) @ self.inverse[c].T) ** 2).sum(axis=1) - 0.5 * self.log_det[c] for c in (0, 1)
        ]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.odds, -500, 500)))


def solve(n: np.ndarray, first: np.ndarray, second: np.ndarray) -> Discriminant:
    """From the count, sum of x and sum of x x' of either class."""
    if n.min() < 2:
        share = float(n[1] / n.sum()) if n.sum() else 0.5
        return Discriminant(np.zeros((2, _D)), np.zeros((2, _D, _D)), np.zeros(2), 0.0, share)
    means = first / n[:, None]
    own = np.array([second[c] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    inverse, log_det = [], []
    for c in (0, 1):
        shrunk = (1 - POOLED) * own[c] + POOLED * pooled
        shrunk = (1 - DIAGONAL) * shrunk + DIAGONAL * np.diag(np.diag(shrunk)) + FLOOR * np.eye(_D)
        factor = np.linalg.cholesky(shrunk)
        inverse.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(inverse), np.array(log_det), float(np.log(n[1] / n[0])))


def fit(rows: DataFrame) -> Discriminant:
    """rows: features array<double>, label int (0 or 1)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = np.zeros(2), np.zeros((2, _D)), np.zeros((2, _D, _D))
        for batch in batches:
            x = transformed(batch.column("features").flatten().to_numpy().reshape(-1, _D))
            label = batch.column("label").to_numpy()
            for c in (0, 1):
                own = x[label == c]
                n[c] += len(own)
                first[c] += own.sum(axis=0)
                second[c] += own.T @ own
        flat = np.concatenate([n, first.ravel(), second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "total"])

    sums = rows.select("features", "label").mapInArrow(add, "at long, total double")
    got = sums.groupBy("at").agg(F.sum("total").alias("total")).toPandas().sort_values("at")["total"].to_numpy()
    if not len(got):
        got = np.zeros(2 + 2 * _D + 2 * _D * _D)
    return solve(got[:2], got[2 : 2 + 2 * _D].reshape(2, _D), got[2 + 2 * _D :].reshape(2, _D, _D))


def scored(stats: DataFrame, model: Discriminant, cut: float = CUT) -> DataFrame:
    """The rows of stats (doc_id, features) with score and predicted."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, _D)
            s = sent.value.score(x) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s), pa.array((s >= cut).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return stats.select("doc_id", "features").mapInArrow(score, "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Rows that no fit sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def classified(docs: DataFrame, labels: DataFrame, target: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every document; the fit sees labelled rows that are not held out."""
    stats = written(document_stats(docs).select("doc_id", "features"), "stats")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    model = fit(stats.join(known, "doc_id"))
    return scored(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
