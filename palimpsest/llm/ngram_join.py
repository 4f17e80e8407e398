"""N-gram Jaccard join by prefixes under several global orders.

A document's set holds its distinct three-word shingles (ASCII-lower-cased words between ASCII
white space; a shorter text is one shingle).  Sets are linked if their Jaccard similarity is
``percent`` or more; the result is exact.

* Orders.  In every total order of all tokens, linked sets share a token of their prefixes, the first
  ``n - ceil(percent * n / 100) + 1`` tokens.  There are ``ORDERS`` orders: tokens that are known to
  be frequent stand last in all of them, and each order has its own hash.  The prefixes under the first
  order are the join keys; a candidate must share a prefix token under the others, too, before full
  sets are compared.
* Frequent tokens.  What repeats within a window of a scan task is counted; the counts over all
  documents name the tokens of ``FREQUENT`` or more.  They are kept as bits of a bitmap of at most
  8 MiB, by hash, so the order stays one and the same for all documents whatever the bitmap
  says: it decides how long the lists are, never what is found.
* Signature.  The numbers of a set's tokens in ``CELLS`` hash cells.  Their absolute differences
  never add up to more than the sets' symmetric difference, so no linked pair is lost by them.

How keys become classes without all pairs of a group is told in ``set_links``.

Defined results.  Null, empty or blank text: no shingles, linked with nothing.  Rows that share a
doc_id count as one document.  A null doc_id is linked with nothing and has a null component.
Other columns are ignored.  An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefilter import KeyBitmap
from ..storage import discard, materialize
from .common import WordHashes, column_bytes, mix, odd_constants
from .set_links import Rule, linked_classes, set_digest

SHINGLE, ORDERS, CELLS, FREQUENT = 3, 3, 128, 16
#: Tokens of a window in which repeats are counted.
WINDOW_TOKENS = 2_000_000
_SALTS = odd_constants(ORDERS, 41)


class OrderRule(Rule):
    """Prefixes of ``percent`` under several orders; ``frequent`` is the packed bitmap of frequent tokens."""

    width = SHINGLE

    def __init__(self, percent: int, frequent: np.ndarray | None = None):
        self.percent = percent
        self.frequent = frequent

    def signature(self, members: np.ndarray) -> np.ndarray:
        counts = np.bincount((members >> np.uint64(57)).astype(np.int64), minlength=CELLS)
        return np.minimum(counts, 255).astype(np.uint8).view(np.uint64)

    def distances(self, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        apart = np.ascontiguousarray(many).view(np.uint8).astype(np.int16) - np.ascontiguousarray(one).view(np.uint8).astype(np.int16)
        return np.abs(apart).sum(axis=-1, dtype=np.int32)

    def bound(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        both = n + m
        return both - 2 * -(-self.percent * both // (100 + self.percent))

    def ranks(self, members: np.ndarray, order: int) -> np.ndarray:
        """Places in an order: frequent tokens have the highest bit set."""
        key = mix(members * _SALTS[order]) >> np.uint64(1)
        if self.frequent is None:
            return key
        place = members & np.uint64(8 * len(self.frequent) - 1)
        bit = (self.frequent[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1)
        return key | (bit.astype(np.uint64) << np.uint64(63))

    def prefix(self, members: np.ndarray, order: int) -> np.ndarray:
        n = len(members)
        size = n - -(-self.percent * n // 100) + 1
        if size >= n:
            return members
        # the token itself decides between equal hashes
        key = self.ranks(members, order)
        last = np.partition(key, size - 1)[size - 1]
        chosen = np.flatnonzero(key <= last)
        if len(chosen) > size:
            chosen = chosen[np.lexsort((members[chosen], key[chosen]))[:size]]
        return members[chosen]

    def prefixes(self, members: np.ndarray) -> list[np.ndarray]:
        return [self.prefix(members, order) for order in range(1, ORDERS)] if len(members) else []


SKETCH = "doc_id long, n_shingles long, set_hi long, set_lo long, fine binary, token long, times long"
_ARROW = [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("fine", pa.binary()), ("token", pa.int64()), ("times", pa.int64())]


def _batch(**columns: list | np.ndarray) -> pa.RecordBatch:
    """A batch of the sketch's schema; columns not given are null."""
    rows = len(next(iter(columns.values())))
    arrays = [pa.array(columns[name], kind) if name in columns else pa.nulls(rows, kind) for name, kind in _ARROW]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(_ARROW))


def _repeated(window: list[np.ndarray]) -> pa.RecordBatch:
    """Tokens that several sets of a window hold, with their number."""
    token, times = np.unique(np.concatenate(window), return_counts=True)
    several = times > 1
    return _batch(token=token[several].view(np.int64), times=times[several].astype(np.int64))


def _sketch(percent: int):
    """Rows of documents, and, with a null ``n_shingles``, rows of tokens that repeat in a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rule = WordHashes(), OrderRule(percent)
        window: list[np.ndarray] = []
        held = 0
        for batch in batches:
            ids, at = batch.column("doc_id").to_pylist(), 0
            rows: list[tuple] = []
            for text in column_bytes(batch, "text"):
                members = rule.shingles(text, words)
                digest = set_digest(members) if len(members) else (None, None)
                rows.append((ids[at], len(members), *digest, rule.signature(members).tobytes() if len(members) else None))
                at += 1
                if len(members):
                    window.append(members)
                    held += len(members)
                if held >= WINDOW_TOKENS:
                    yield _repeated(window)
                    window, held = [], 0
            yield _batch(**dict(zip(("doc_id", "n_shingles", "set_hi", "set_lo", "fine"), map(list, zip(*rows))))) if rows else _batch(doc_id=[])
        if window:
            yield _repeated(window)

    return run


def frequent_tokens(repeats: DataFrame, least: int = FREQUENT) -> np.ndarray | None:
    """The packed bitmap (8 MiB at most) of the tokens counted ``least`` times or more; None without any."""
    tokens = materialize(repeats.groupBy("token").agg(F.sum("times").alias("times")).filter(F.col("times") >= least).select("token"), "frequent")
    bits = KeyBitmap(tokens, F.col("token")).to_bytes()
    discard(tokens)
    return np.frombuffer(bits, np.uint8) if any(bits) else None


def _prefix_rows(rule: OrderRule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            ids, at = batch.column("doc_id").to_pylist(), 0
            nodes, keys = [], []
            for text in column_bytes(batch, "text"):
                members = rule.shingles(text, words)
                if len(members):
                    nodes.append(ids[at])
                    keys.append(rule.prefix(members, 0).view(np.int64))
                at += 1
                if len(nodes) == 2000:
                    yield _keys_batch(nodes, keys)
                    nodes, keys = [], []
            yield _keys_batch(nodes, keys)

    return run


def _keys_batch(nodes: list, keys: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
    values = np.concatenate(keys) if keys else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))], names=["id", "keys"])


def jaccard_classes(docs: DataFrame, percent: int = 90) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``.

    Documents are linked if ``100 * |A & B| >= percent * |A | B|``; ``component_id`` is the smallest
    doc_id reachable by links, the own one included.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = materialize(docs.mapInArrow(_sketch(percent), SKETCH), "sketch")
    rule = OrderRule(percent, frequent_tokens(told.filter("n_shingles is null").select("token", "times")))
    sketch = told.filter("n_shingles is not null").select("doc_id", "n_shingles", "set_hi", "set_lo", "fine")

    def keys_of(nodes: DataFrame) -> DataFrame:
        prefixes = docs.filter("doc_id is not null").mapInArrow(_prefix_rows(rule), "id long, keys array<long>")
        return prefixes.join(nodes, F.col("id") == F.col("node"), "left_semi").select(F.explode("keys").alias("key"), F.col("id").alias("node"))

    found = linked_classes(docs, sketch, keys_of, rule)
    return found.select("doc_id", "n_shingles", "component_id")
