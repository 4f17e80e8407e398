"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed n-grams: words, word pairs, word shapes and their
pairs and triples, and runs of six "equals the word before" flags.  Each indicator
is scaled by the class log-count ratio of its feature; a linear hinge-loss model is
fitted by dual coordinate descent, and its margin is mapped to (0, 1) by a logistic
curve fitted on margins of documents left out of the fit.

The model is fitted on at most ``rows`` labelled documents, collected as feature
numbers; every whole text is scored in one pass without a shuffle.

Defined results.  Null, empty and blank texts have no features and get the score of
the bias alone.  Without labels of both classes every score is 0.5.  Repeated rows
each get a row; a null doc_id is scored and counts as not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import WORD_CACHE, column_bytes, crc_fold, mix, odd_constants
from .labels import labelled

BITS = 18
ROWS = 4000
_C = odd_constants(16, 101)
_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_SHAPE = bytes.maketrans(_UPPER + _LOWER + b"0123456789" + bytes(range(128, 256)), b"A" * 26 + b"a" * 26 + b"9" * 10 + b"a" * 128)


def _shape(word: bytes) -> bytes:
    """Classes of characters in order of appearance, runs as one."""
    mapped = word[:64].translate(_SHAPE)
    return bytes(c for i, c in enumerate(mapped) if not i or mapped[i - 1] != c)


class _Tokens(dict):
    """Word -> number; the numbers index arrays of word and shape hashes."""

    def __init__(self):
        self.words: list[int] = []
        self.shapes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(xxhash.xxh3_64_intdigest(word.lower()))
        self.shapes.append(xxhash.xxh3_64_intdigest(_shape(word), 1))
        return n

    def arrays(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > WORD_CACHE:
            self.clear(), self.words.clear(), self.shapes.clear()
        ids = list(map(self.__getitem__, words))
        return np.array([self.words[i] for i in ids], np.uint64), np.array([self.shapes[i] for i in ids], np.uint64)


def features(text: bytes | None, tokens: _Tokens) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    parts = text.split() if text else []
    if not parts:
        return np.empty(0, np.uint32)
    w, s = tokens.arrays(parts)
    found = [w * _C[0], s * _C[1] + np.uint64(1)]
    if len(w) > 1:
        found += [w[:-1] * _C[2] + w[1:] * _C[3], s[:-1] * _C[4] + s[1:] * _C[5]]
    if len(w) > 2:
        found.append(s[:-2] * _C[6] + s[1:-1] * _C[7] + s[2:] * _C[8])
    if len(w) > 6:
        same = (w[1:] == w[:-1]).astype(np.uint64)
        run = sum(same[k : len(same) - 5 + k] << np.uint64(k) for k in range(6))
        found.append((np.unique(run) + np.uint64(1)) * _C[9])
    return np.unique((mix(np.concatenate(found)) >> np.uint64(64 - BITS)).astype(np.uint32))


@dataclass
class Model:
    weight: np.ndarray  # per feature: log-count ratio times the linear weight
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weight[found].sum()) / np.sqrt(max(1, len(found))) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.offset, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    total = {c: np.ones(1 << BITS) for c in (1, -1)}
    for found, label in zip(rows, y):
        total[label][found] += 1
    share = {c: t / (1 + (y == c).sum()) for c, t in total.items()}
    return np.log(share[1]) - np.log(share[-1])


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, passes: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum cost * hinge, by dual coordinate descent."""
    w, bias = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[f] / np.sqrt(max(1, len(f))) for f in rows]
    norm = np.array([v @ v + 1 for v in values])
    order = np.random.default_rng(7)
    for _ in range(passes):
        moved = 0.0
        for i in order.permutation(len(rows)):
            g = y[i] * (values[i] @ w[rows[i]] + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def _fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    ratio = log_count_ratios(rows, y)
    share = {c: (y == c).mean() for c in (1, -1)}
    cost = np.array([0.5 / share[c] for c in y])
    w, bias = dual_descent(rows, y, ratio, cost)
    return Model((w * ratio).astype(np.float32), bias, 1.0, 0.0)


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit, with a little smoothing of the targets."""
    n1, n0 = (y == 1).sum(), (y != 1).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (theta - [1, 0]))
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def train(rows: list[np.ndarray], label: np.ndarray) -> Model:
    """A model of documents given by their features; label: 0 or 1."""
    y = np.where(np.asarray(label) == 1, 1, -1)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, 0.0)
    fold = np.arange(len(rows)) % 3
    margin = np.zeros(len(rows))
    for k in range(3):
        kept = np.flatnonzero(fold != k)
        part = _fit([rows[i] for i in kept], y[kept]) if len(set(y[kept].tolist())) == 2 else Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            margin[i] = part.margin(rows[i])
    model = _fit(rows, y)
    model.slope, model.offset = logistic_curve(margin, y)
    return model


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = _Tokens()
    for batch in batches:
        found = [features(t, tokens).tobytes() for t in column_bytes(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], names=["doc_id", "label", "found"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    sample = labelled(docs, labels, label, rows).mapInArrow(_featurize, "doc_id long, label int, found binary").collect()
    sample.sort(key=lambda r: r["doc_id"])
    return train([np.frombuffer(bytes(r["found"]), np.uint32) for r in sample], np.array([r["label"] for r in sample]))


def score(docs: DataFrame, model: Model, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs``, and the score of ``text`` from 0 to 1 as column ``name``."""
    given = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for batch in batches:
            values = [model.score(features(t, tokens)) for t in column_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())], names=[*batch.schema.names[:-1], "s"])

    scored = given.mapInArrow(run, StructType([*given.schema.fields[:-1], StructField("s", DoubleType())]))
    return scored.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("s").alias(name))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document."""
    scored = score(docs, fit(docs, labels, rows=rows), ["doc_id"])
    return scored.select("doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
