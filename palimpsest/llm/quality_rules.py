"""Quality rules: gradient-boosted trees over document statistics.

Trees of bounded depth are grown on the logistic loss over binned statistics and
kept as flat node arrays, so a block of documents walks them by numpy indexing.
``MONOTONE`` fixes the direction of chosen statistics: a split whose children would
contradict it is not taken, and both children inherit the midpoint as a bound.

The trees are fitted on at most ``rows`` labelled documents outside the held-out
fold; all counts are of whole texts, in one pass without a shuffle.

Defined results.  Null, empty and blank texts have counts of 0 and fail the base
rules.  Without labels of both classes the trees keep everything.  A row per input
row, whatever its doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, column_bytes
from .labels import labelled
from .text_stats import BASE, STATISTICS, statistics

ROWS, BINS = 4000, 32
TREES, DEPTH, RATE = 60, 4, 0.2
#: -1: a higher value never raises the score, +1: never lowers it.
MONOTONE = {"symbols_per_word": -1, "repeat_words": -1, "dup_lines": -1, "marked_words": -1}
#: Least probability of good quality that is kept.
KEEP = 0.3


@dataclass
class Forest:
    """All trees' nodes in flat arrays; a leaf points to itself."""

    feature: np.ndarray
    bound: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    root: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.bound[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def train(x: np.ndarray, label: np.ndarray, monotone: dict[str, int] | None = None, ridge: float = 1.0, least: int = 8) -> Forest:
    """Boosted trees of the rows of ``x`` (columns: STATISTICS); label: 0 or 1."""
    y = (np.asarray(label) == 1).astype(float)
    sign = np.array([(MONOTONE if monotone is None else monotone).get(c, 0) for c in STATISTICS])
    nodes: dict[str, list] = {"feature": [], "bound": [], "left": [], "right": [], "value": []}

    def node(value: float) -> int:
        k = len(nodes["value"])
        for name, v in zip(nodes, (0, np.inf, k, k, value)):
            nodes[name].append(v)
        return k

    def frozen(roots: list[int], start: float) -> Forest:
        kinds = (np.int32, np.float64, np.int32, np.int32, np.float64)
        return Forest(*[np.array(v, t) for v, t in zip(nodes.values(), kinds)], np.array(roots, np.int32), start)

    if not len(y) or y.min() == y.max():
        return frozen([node(0.0)], 10.0 if not len(y) or y[0] else -10.0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    weight = np.where(y == 1, 1.0, min(5.0, (y == 1).sum() / (y == 0).sum()) ** 0.5)
    p = (weight * y).sum() / weight.sum()
    start = float(np.log(p / (1 - p)))
    margin = np.full(len(y), start)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        k = node(RATE * leaf(g[rows].sum(), h[rows].sum(), low, high))
        best = (1e-6, None)
        if depth and len(rows) >= 2 * least:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                size = len(c) + 1
                gl = np.cumsum(np.bincount(binned[rows, f], g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, f], h[rows], size))[:-1]
                nl = np.cumsum(np.bincount(binned[rows, f], minlength=size))[:-1]
                gr, hr = total_g - gl, total_h - hl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total_g**2 / (total_h + ridge)
                fits = (nl >= least) & (len(rows) - nl >= least) & (sign[f] * (vr - vl) >= 0)
                gain = np.where(fits, gain, -np.inf)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], (f, j, float(vl[j]), float(vr[j])))
        if best[1]:
            f, j, vl, vr = best[1]
            goes = binned[rows, f] <= j
            middle = (vl + vr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(sign[f])]
            nodes["feature"][k], nodes["bound"][k] = f, float(cuts[f][j])
            nodes["left"][k] = grow(rows[goes], g, h, depth - 1, *bounds[0])
            nodes["right"][k] = grow(rows[~goes], g, h, depth - 1, *bounds[1])
        return k

    roots = []
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), weight * (q - y), weight * q * (1 - q), DEPTH, -np.inf, np.inf))
        margin = margin + frozen(roots[-1:], 0.0).margin(x)
    return frozen(roots, start)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        rows = [statistics(t, words)[1].tolist() for t in column_bytes(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> Forest:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    sample = labelled(docs, labels, label, rows).mapInArrow(_measured, "doc_id long, label int, x array<double>").collect()
    sample.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in sample], float).reshape(-1, len(STATISTICS))
    return train(x, np.array([r["label"] for r in sample]))


def quality_rules(docs: DataFrame, labels: DataFrame, keep: float = KEEP, rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)``."""
    forest = fit(docs, labels, rows=rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            found = [statistics(t, words) for t in column_bytes(batch, "text")]
            counts = np.array([f[0] for f in found], np.int64).reshape(-1, len(BASE))
            x = np.array([f[1] for f in found]).reshape(-1, len(STATISTICS))
            score = np.concatenate([forest.score(x[i : i + 1000]) for i in range(0, len(x), 1000)]) if len(x) else np.zeros(0)
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c) for c in counts.T], pa.array(failed), pa.array(score, pa.float64()), pa.array(~failed & (score >= keep))],
                names=["doc_id", *BASE, "base_failed", "score", "kept"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean"
    return texts.mapInArrow(run, schema)
