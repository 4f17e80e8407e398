"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds its distinct five-word shingles (ASCII-lower-cased words
between ASCII white space; a shorter text is one shingle).  Its signature has
``CHUNKS * WIDTH`` index symbols of 16 bits and ``FINE`` symbols of 4 bits, all
low bits of minima of one hash family.

* Index.  The index symbols are split into ``CHUNKS`` chunks.  Two signatures
  that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` symbols agree, by the
  pigeonhole principle, on some chunk up to ``ERRORS`` symbols, so the keys of all
  ways to leave out one symbol of a chunk meet.  Pairs beyond that distance meet
  with the probability of the formula in ``miss_probability``.

Fine symbols are compared with a bound more than six standard deviations beyond what
similarity 0.85 gives.  How keys become classes is told in ``set_links``.

Defined results.  Null, empty or blank text: no shingles, linked with nothing,
kept.  Rows that share a doc_id count as one document.  A null doc_id is linked
with nothing, has a null component and is kept.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from ..operators.prefilter import KeyBitmap
from ..storage import materialize
from .common import WordHashes, column_bytes, mix, odd_constants
from .set_links import Rule, linked_classes, set_digest, shingle_set

SHINGLE = 5
CHUNKS, WIDTH, ERRORS, FINE = 8, 5, 1, 128
INDEX = CHUNKS * WIDTH
_FAMILY = odd_constants(max(INDEX, FINE), 29)
_NIBBLES = np.uint64(0x1111111111111111)


def miss_probability(similarity: float) -> float:
    """Chance that two sets of this similarity share no index key."""
    one = similarity**WIDTH + WIDTH * similarity ** (WIDTH - 1) * (1 - similarity)
    return (1 - one) ** CHUNKS


def fine_bound(similarity: float, sigmas: float = 6.5) -> int:
    """Largest number of differing fine symbols that a linked pair may show."""
    p = (1 - similarity) * 15 / 16
    return math.ceil(FINE * p + sigmas * math.sqrt(FINE * p * (1 - p)))


def minima(members: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set."""
    low = np.full(len(_FAMILY), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(members), 2048):
        part = members[start : start + 2048]
        np.minimum(low, (part[None, :] * _FAMILY[:, None]).min(axis=1), out=low)
    return low


def fine_symbols(low: np.ndarray) -> np.ndarray:
    """FINE symbols of four bits, packed into words of 64 bits."""
    nibble = (mix(low[:FINE]) >> np.uint64(60)).reshape(-1, 16)
    return (nibble << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=1, dtype=np.uint64)


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """Keys of signatures (rows of INDEX symbols): each chunk with one symbol left out."""
    s = symbols.astype(np.uint64).reshape(len(symbols), CHUNKS, WIDTH)
    keys = np.empty((len(symbols), CHUNKS, WIDTH), np.uint64)
    for out in range(WIDTH):
        packed = np.zeros((len(symbols), CHUNKS), np.uint64)
        for k in (k for k in range(WIDTH) if k != out):
            packed = (packed << np.uint64(16)) | s[:, :, k]
        salt = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(out + 1)
        keys[:, :, out] = mix(packed + mix(salt)[None, :])
    return keys.reshape(len(symbols), INDEX).view(np.int64)


def distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Number of differing four-bit symbols between a packed signature and others."""
    x = one ^ many
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & _NIBBLES).sum(axis=-1, dtype=np.int32)


SKETCH = "doc_id long, n_shingles long, set_hi long, set_lo long, fine binary, symbols binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("fine", pa.binary()), ("symbols", pa.binary())])
    for batch in batches:
        sizes, his, los, fines, symbols = [], [], [], [], []
        for text in column_bytes(batch, "text"):
            members = shingle_set(text, words, SHINGLE)
            sizes.append(len(members))
            if not len(members):
                his.append(None), los.append(None), fines.append(None), symbols.append(None)
                continue
            hi, lo = set_digest(members)
            his.append(hi), los.append(lo)
            low = minima(members)
            fines.append(fine_symbols(low).tobytes())
            symbols.append((mix(low[:INDEX] + np.uint64(7)) >> np.uint64(48)).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(fines, pa.binary()), pa.array(symbols, pa.binary())], schema=schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            symbols = np.frombuffer(b"".join(part.column("symbols").to_pylist()), "<u2").reshape(-1, INDEX)
            keys = index_keys(symbols)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("node").to_numpy(), INDEX))], names=["key", "node"])


class MinHashRule(Rule):
    """Five-word shingles; signatures are the fine symbols, with a bound far beyond what linked sets show."""

    width = SHINGLE

    def __init__(self, percent: int):
        self.percent = percent
        self.most = fine_bound(percent / 100)

    def signature(self, members: np.ndarray) -> np.ndarray:
        return fine_symbols(minima(members))

    def distances(self, one: np.ndarray, many: np.ndarray) -> np.ndarray:
        return distances(one, many)

    def bound(self, n: np.ndarray, m: np.ndarray) -> int:
        return self.most


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, repeated)``, one row per row of ``docs``.

    Documents are linked if ``100 * |A & B| >= percent * |A | B|``; ``repeated`` tells that
    several rows have this doc_id.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = materialize(docs.mapInArrow(_sketch, SKETCH), "sketch")
    return linked_classes(docs, sketch, lambda nodes: nodes.mapInArrow(_keys, "key long, node long"), MinHashRule(percent), ("symbols",))


def _orderable(row: Column, fields: list[StructField]) -> Column:
    """Fields of a row as something that has an order; types without one are written as JSON."""
    kinds = ("map<", "variant", "geometry", "geography")
    return F.struct(*[F.to_json(F.struct(row[f.name])) if any(k in f.dataType.simpleString() for k in kinds) else row[f.name] for f in fields])


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, and the smallest row of a repeated doc_id."""
    found = near_duplicates(docs, percent).filter("doc_id is not null and (repeated or not kept)")
    special = materialize(found.select(F.col("doc_id").alias("special_id"), F.col("kept").alias("special_kept")).distinct(), "special")
    # the caller's columns travel in one, so none of their names can clash
    rows = docs.select(F.struct("*").alias("row"))
    own = F.col("row")["doc_id"].cast("long")
    marked = KeyBitmap(special, F.xxhash64("special_id")).mark(rows, F.xxhash64(own), "doubtful")
    looked = marked.filter("doubtful").join(special, own == F.col("special_id"), "left")
    several = looked.filter("special_kept").groupBy("special_id").agg(F.min_by("row", _orderable(F.col("row"), docs.schema.fields)).alias("row"))
    plain = marked.filter("not doubtful").select("row").unionByName(looked.filter("special_kept is null").select("row"))
    return plain.unionByName(several.select("row")).select("row.*")
