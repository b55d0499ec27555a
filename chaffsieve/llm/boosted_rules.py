"""Quality rules: plain count rules, then gradient-boosted trees over document statistics.

The trees are grown on histograms of logistic gradients, flattened into numpy node arrays (feature, cut, left, right,
value) and scored for whole batches, level by level. On chosen features the score may only fall (or only rise): a split
is taken only if its child values keep that order, and children are held to the side of the middle that is theirs.

The fit takes at most FIT_ROWS labelled documents, those of the smallest hash of doc_id; everything else covers all rows.

Defined cases: null, empty and wordless texts have zero counts and fail the count rules; without labels of both classes
the trees keep everything; repeated documents each get a row; equal hashes are ordered by doc_id. To the fit a doc_id is
one document: of different labels the smaller counts, of different texts the one whose statistics come first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffsieve.llm._common import slices, texts
from chaffsieve.llm.stats import COUNTS, FEATURES, document_stats, measured

FIT_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 40, 4, 0.2, 64, 20, 1.0
#: A document scoring below this is rejected.
REJECT_BELOW = 0.2
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: More of these never makes a text better.
FALLING = ("symbols", "pipes", "exclaims", "dup_lines", "repeats", "marked_words")
_D = len(FEATURES)
_SIGN = np.array([-1 if f in FALLING else 0 for f in FEATURES])


@dataclass(frozen=True)
class Forest:
    """All trees in one set of node arrays; leaves point to themselves."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    base = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(_D)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(_D)], axis=1)
    offset = np.arange(_D) * (BINS + 1)
    nodes: list[list] = []
    roots = []
    total = np.full(len(x), base)

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float) -> tuple | None:
        flat = (binned[rows] + offset).ravel()
        shape, size = (_D, BINS + 1), _D * (BINS + 1)
        sums = [np.bincount(flat, np.repeat(v, _D), size).reshape(shape) for v in (g[rows], h[rows], np.ones(len(rows)))]
        gl, hl, nl = (s.cumsum(axis=1)[:, :-1] for s in sums)
        gt, ht, nt = g[rows].sum(), h[rows].sum(), len(rows)
        vl = np.clip(-gl / (hl + RIDGE), low, high)
        vr = np.clip(-(gt - gl) / (ht - hl + RIDGE), low, high)
        gain = -(gl * vl + 0.5 * (hl + RIDGE) * vl**2) - ((gt - gl) * vr + 0.5 * (ht - hl + RIDGE) * vr**2)
        whole = np.clip(-gt / (ht + RIDGE), low, high)
        gain += gt * whole + 0.5 * (ht + RIDGE) * whole**2
        gain[(nl < LEAST_ROWS) | (nt - nl < LEAST_ROWS) | (_SIGN[:, None] * (vr - vl) < 0)] = -np.inf
        gain[np.arange(BINS)[None, :] >= np.array([len(c) for c in cuts])[:, None]] = -np.inf
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        return (f, b, vl[f, b], vr[f, b]) if gain[f, b] > 1e-6 else None

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        split = best(rows, g, h, low, high) if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS else None
        if split is None:
            value = RATE * float(np.clip(-g[rows].sum() / (h[rows].sum() + RIDGE), low, high))
            total[rows] += value
            return leaf(value)
        f, b, vl, vr = split
        at = leaf(0.0)
        goes = binned[rows, f] <= b
        middle = (vl + vr) / 2
        bounds = ((low, high),) * 2
        if _SIGN[f]:
            bounds = ((low, middle), (middle, high)) if _SIGN[f] > 0 else ((middle, high), (low, middle))
        left = build(rows[goes], g, h, depth + 1, *bounds[0])
        right = build(rows[~goes], g, h, depth + 1, *bounds[1])
        nodes[at] = [f, cuts[f][b], left, right, 0.0]
        return at

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        roots.append(build(np.arange(len(x)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    columns = list(zip(*nodes, strict=True))
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return Forest(*(np.array(c, k) for c, k in zip(columns, kinds, strict=True)), np.array(roots), base)


def fitted(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = FIT_ROWS) -> Forest | None:
    """The trees for the labels of at most `rows` documents; None without rows of both classes.

    Only the labels of these rows are broadcast and only their statistics reach the driver: both have `rows` rows.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
    known = known.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toPandas()
    if known["label"].nunique() < 2:
        return None
    ids = docs.sparkSession.createDataFrame(known[["doc_id"]])
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    got = document_stats(chosen).groupBy("doc_id").agg(F.min("features").alias("features")).toPandas()
    got = got.merge(known, on="doc_id").sort_values("doc_id")
    if got["label"].nunique() < 2:
        return None
    return grow(np.stack(got["features"].to_numpy()), got["label"].to_numpy(np.float64))


def verdicts(bodies: list[bytes | None], forest: Forest | None, least: float) -> tuple:
    """COUNTS, base_failed, score and kept of texts."""
    counts, features = measured(bodies)
    n, repeated = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
    bad = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
    score = forest.score(features) if forest is not None else np.ones(len(features))
    return counts, bad, score, ~bad & (score >= least)


def judged(docs: DataFrame, labels: DataFrame, target: str = "quality", least: float = REJECT_BELOW) -> DataFrame:
    """doc_id, COUNTS, base_failed, score and kept for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, target))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, bad, score, kept = verdicts(part.column("body").to_pylist(), sent.value, least)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c) for c in counts.T.copy()), *map(pa.array, (bad, score, kept))],
                names=["doc_id", *COUNTS, "base_failed", "score", "kept"],
            )

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return texts(docs).mapInArrow(judge, f"doc_id long, {counts}, base_failed boolean, score double, kept boolean")


def filtered(docs: DataFrame, labels: DataFrame, target: str = "quality", least: float = REJECT_BELOW) -> DataFrame:
    """The documents that pass, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, target))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            bodies = part.column("text").cast(pa.binary()).to_pylist()
            yield part.filter(pa.array(verdicts(bodies, sent.value, least)[3]))

    return docs.mapInArrow(keep, docs.schema)
