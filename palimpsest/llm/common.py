"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD_CACHE = 150_000


class WordHashes(dict):
    """64-bit hash of a word's bytes, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def column_bytes(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, a slice at a time."""
    col = batch.column(name)
    for start in range(0, len(col), 256):
        part = col.slice(start, 256)
        yield from part.cast(pa.large_binary() if pa.types.is_large_string(part.type) else pa.binary()).to_pylist()


def slices(column: pa.Array, rows: int = 256) -> Iterator[list]:
    for start in range(0, len(column), rows):
        yield column.slice(start, rows).to_pylist()


def crc_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string")) % F.lit(folds)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
