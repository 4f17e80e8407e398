"""Toxicity: a convolutional text classifier in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first five
and seven bytes, so that unseen endings of a known stem are recognised.  Filters of
widths one to three slide over the whole text; the maximum of each goes through one
linear layer.  Only the positions of the maxima carry gradients, so training touches
a few embeddings per document and filter.

Each language of the training documents has a threshold of its own, calibrated on those
that the calibrating network did not see.  Languages enter verdicts only, never a score.

Defined results.  Null, empty and blank texts get the score of the bias alone.
Without labels of both classes every score is 0.5.  Repeated rows each get a row; a
null doc_id is scored and counts as not held out.  A language that is null or has few
labelled documents has the threshold 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import WORD_CACHE, column_bytes, crc_fold
from .labels import labelled
from .quality_nbsvm import logistic_curve

BUCKETS, DIM, FILTERS = 1 << 15, 12, 12
WIDTHS = (1, 2, 3)
PREFIXES = (5, 7)
ROWS = 4000
CHUNK = 50_000


class _Ids(dict):
    """Word -> bucket numbers of the word and of its prefixes, as a row of a table."""

    def __init__(self):
        self.rows: list[tuple[int, ...]] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.rows)
        low = word.lower().strip(b".,;:!?*&%$#|\"'()[]")
        self.rows.append(tuple(xxhash.xxh3_64_intdigest(low[:k], k) % BUCKETS for k in (*PREFIXES, 10**6)))
        return n

    def matrix(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORD_CACHE:
            self.clear(), self.rows.clear()
        ids = list(map(self.__getitem__, words))
        return np.array([self.rows[i] for i in ids], np.int32).reshape(-1, len(PREFIXES) + 1)


def word_buckets(text: bytes | None, ids: _Ids) -> np.ndarray:
    """One row of bucket numbers per word of the text."""
    return ids.matrix(text.split() if text else [])


@dataclass
class Network:
    table: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # per width: (width * DIM) x FILTERS
    bases: list[np.ndarray]
    top: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        normal = lambda *shape: r.normal(0, 0.1, shape).astype(np.float32)
        return Network(normal(BUCKETS, DIM), [normal(w * DIM, FILTERS) * 3 for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(len(WIDTHS) * FILTERS), 0.0)

    def pooled(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over the text (0 at least) and where it stands."""
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        where = np.full(len(best), -1)
        for start in range(0, len(buckets), CHUNK):
            part = buckets[start : start + CHUNK + max(WIDTHS) - 1]
            vectors = self.table[part].sum(axis=1)
            for k, width in enumerate(WIDTHS):
                n = len(part) - width + 1
                if n < 1:
                    continue
                windows = vectors if width == 1 else np.concatenate([vectors[j : j + n] for j in range(width)], axis=1)
                out = windows @ self.filters[k] + self.bases[k]
                at = out.argmax(axis=0)
                value = out[at, np.arange(FILTERS)]
                span = slice(k * FILTERS, (k + 1) * FILTERS)
                better = value > best[span]
                best[span][better] = value[better]
                where[span][better] = at[better] + start
        return best, where

    def margin(self, buckets: np.ndarray) -> float:
        return float(self.pooled(buckets)[0] @ self.top + self.bias)

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(buckets) + self.offset, -30, 30))))


def _train_network(rows: list[np.ndarray], y: np.ndarray, passes: int, seed: int = 5, rate: float = 0.08) -> Network:
    """Adagrad on the logistic loss, one document at a time, rarer class weighted up."""
    net = Network.fresh(seed)
    g_table = np.full(BUCKETS, 1e-4, np.float32)
    g_filters = [np.full(f.shape, 1e-2, np.float32) for f in net.filters]
    g_top = np.full(net.top.shape, 1e-2, np.float32)
    weight = {1: min(4.0, (y == 0).sum() / max(1, (y == 1).sum())) ** 0.5, 0: 1.0}
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            best, where = net.pooled(rows[i])
            p = 1 / (1 + np.exp(-np.clip(best @ net.top + net.bias, -30, 30)))
            g = np.float32((p - y[i]) * weight[int(y[i])])
            if abs(g) < 0.01:
                continue
            d_best = g * net.top
            d_top = g * best + np.float32(1e-4) * net.top
            g_top += d_top * d_top
            net.top -= rate * d_top / np.sqrt(g_top)
            net.bias -= 0.02 * g
            for k, width in enumerate(WIDTHS):
                used = np.flatnonzero(where[k * FILTERS : (k + 1) * FILTERS] >= 0)
                if not len(used):
                    continue
                d = d_best[k * FILTERS + used]
                at = where[k * FILTERS + used]
                places = rows[i][at[:, None] + np.arange(width)]  # used x width x ids
                vectors = net.table[places].sum(axis=2).reshape(len(used), -1)
                d_filter = vectors * d[:, None]
                d_vector = (net.filters[k][:, used].T * d[:, None]).reshape(len(used), width, DIM)
                g_filters[k][:, used] += d_filter.T**2
                net.filters[k][:, used] -= rate * d_filter.T / np.sqrt(g_filters[k][:, used])
                net.bases[k][used] -= 0.02 * d
                spots = places.reshape(-1)
                grad = np.repeat(d_vector.reshape(-1, DIM), places.shape[2], axis=0)
                touched, back = np.unique(spots, return_inverse=True)
                total = np.zeros((len(touched), DIM), np.float32)
                np.add.at(total, back, grad)
                g_table[touched] += (total**2).mean(axis=1)
                net.table[touched] -= rate * total / np.sqrt(g_table[touched])[:, None]
    return net


def best_threshold(score: np.ndarray, y: np.ndarray, steps: int = 20) -> float:
    """The grid point of best F1, of equal ones the nearest to 0.5."""
    grid = np.arange(1, steps) / steps
    said = score[None, :] >= grid[:, None]
    f1 = 2 * (said & (y == 1)).sum(axis=1) / np.maximum(1, said.sum(axis=1) + (y == 1).sum())
    return float(min(zip(-f1, np.abs(grid - 0.5), grid))[2])


def train(rows: list[np.ndarray], label: np.ndarray, lang: list[str | None] | None = None, passes: int = 6, least: int = 40) -> Network:
    """A network of documents given by their buckets, with a calibrated logistic curve.

    A language has its own threshold if ``least`` documents of it, of both classes, calibrate it.
    """
    y = (np.asarray(label) == 1).astype(np.int64)
    if len(set(y.tolist())) < 2:
        net = Network.fresh()
        net.top[:] = 0
        return net
    kept = np.arange(len(rows)) % 4 != 0
    inner = _train_network([rows[i] for i in np.flatnonzero(kept)], y[kept], passes) if len(set(y[kept].tolist())) == 2 else None
    net = _train_network(rows, y, passes)
    if inner is not None and len(set(y[~kept].tolist())) == 2:
        margin = np.array([inner.margin(rows[i]) for i in np.flatnonzero(~kept)])
        net.slope, net.offset = logistic_curve(margin, np.where(y[~kept] == 1, 1, -1))
        score = 1 / (1 + np.exp(-np.clip(net.slope * margin + net.offset, -30, 30)))
        langs = np.array([(lang or [None] * len(rows))[i] or "" for i in np.flatnonzero(~kept)])
        for name in sorted(set(langs.tolist()) - {""}):
            mine = langs == name
            if mine.sum() >= least and len(set(y[~kept][mine].tolist())) == 2:
                net.thresholds[name] = best_threshold(score[mine], y[~kept][mine])
    return net


def _bucketize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = _Ids()
    for batch in batches:
        found = [word_buckets(t, ids).astype("<u2").tobytes() for t in column_bytes(batch, "text")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "label", "lang")], pa.array(found, pa.binary())], names=["doc_id", "label", "lang", "found"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS) -> Network:
    """Fit on at most ``rows`` labelled documents outside the held-out fold."""
    sample = labelled(docs, labels, label, rows).mapInArrow(_bucketize, "doc_id long, label int, lang string, found binary").collect()
    sample.sort(key=lambda r: r["doc_id"])
    found = [np.frombuffer(bytes(r["found"]), "<u2").astype(np.int32).reshape(-1, len(PREFIXES) + 1) for r in sample]
    return train(found, np.array([r["label"] for r in sample]), [r["lang"] for r in sample])


def score(docs: DataFrame, net: Network, keep: list[str], name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs``, and the score of ``text`` from 0 to 1 as column ``name``."""
    given = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids()
        for batch in batches:
            values = [net.score(word_buckets(t, ids)) for t in column_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())], names=[*batch.schema.names[:-1], "s"])

    scored = given.mapInArrow(run, StructType([*given.schema.fields[:-1], StructField("s", DoubleType())]))
    return scored.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("s").alias(name))


def by_language(score_column: Column, lang: Column, net: Network) -> Column:
    """Whether the score reaches the threshold of the row's language."""
    bound = F.lit(0.5)
    for name, value in net.thresholds.items():  # a language of the sample each
        bound = F.when(lang == name, value).otherwise(bound)
    return score_column >= bound


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted, toxic_by_language)`` of every document."""
    net = fit(docs, labels, rows=rows)
    texts = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    scored = score(texts, net, ["doc_id", "lang"])
    held_out = F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), by_language(F.col("score"), F.col("lang"), net).alias("toxic_by_language"))
