"""Packing token sequences: cutting stock by column generation.

A document's ids are cut into pieces of ``capacity`` tokens and a rest.  Lengths are
counted in bins of ``GRAIN`` tokens (rounded up, so a pattern always fits); the
histogram of at most ``capacity / GRAIN`` numbers is all that reaches the driver.
There a linear program over patterns is solved by the revised simplex method, whose
columns are priced by the dynamic program of the unbounded knapsack.  Patterns are
rounded down; what is left over (at most a few pieces per bin) is packed by best
fit.  Rounding lengths up to whole bins is the only loss against the linear program.
Pieces are ranked within their bin across the cluster, and a piece's rank
names its pattern, sequence and slot.

Ids come from the rank file that holds the same vocabulary as the tokenizer file and
are looked up by blank-separated unit; texts that contain a special token's string go
through the tokenizer itself.

Defined results.  Null text counts as empty: its only id is the end mark.  Repeated
rows and null doc_ids are packed like any other row.  An empty table has no pieces.
Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import slices

CAPACITY, GRAIN, END = 2048, 8, 1
UNIT_CACHE = 300_000
PER_SALT = 100_000


def tokenizer_files() -> tuple[str, str]:
    """Default places of the tokenizer and of its ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder(dict):
    """Text -> little-endian 32-bit ids, by a bounded memory of units.

    A unit starts at a blank that does not follow white space.  The tokenizer's pattern
    never joins what stands on the two sides of such a place, so units are encoded alone.
    """

    def __init__(self, files: tuple[str, str]):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(files[1], "rb"))}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokenizer = Tokenizer.from_file(files[0])
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.run = re.compile(r"\s ")
        self.start = re.compile(r"(?<!\s) ")

    def _ids(self, text: str) -> bytes:
        return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= UNIT_CACHE:
            self.clear()
        out = self._ids(" " + unit)
        if len(unit) <= 48:
            self[unit] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        units = self.start.split(text) if self.run.search(text) else text.split(" ")
        first = units[0]
        rest = map(self.__getitem__, units[1:])
        return b"".join([self._ids(first) if first else b"", *rest])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece of a document's ids; ``with_ids`` adds them as ``ids`` (binary)."""
    files = files or tokenizer_files()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    mark = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(files)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            docs_ids = batch.column("doc_id").to_pylist()
            at = 0
            for texts in slices(batch.column("text")):
                for text in texts:
                    ids = encoder.encode(text) + mark
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        part = ids[4 * start : 4 * (start + capacity)]
                        for column, value in zip(rows, (docs_ids[at], start, len(part) // 4, zlib.crc32(part), total, part)):
                            column.append(value)
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n != "ids" else pa.binary()) for n, c in zip(names, rows)], names=names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, PIECES + ", ids binary" * with_ids)


def best_pattern(price: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the dearest multiset of bins (bin i takes i + 1 units)."""
    best = np.zeros(units + 1)
    took = np.full(units + 1, -1)
    for c in range(1, units + 1):
        value = best[c - 1 :: -1][: min(c, len(price))] + price[: min(c, len(price))]
        k = int(value.argmax())
        if value[k] > best[c - 1] + 1e-15:
            best[c], took[c] = value[k], k
        else:
            best[c] = best[c - 1]
    pattern = np.zeros(len(price), np.int64)
    c = units
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= took[c] + 1
    return float(best[units]), pattern


def first_patterns(demand: np.ndarray, power: float = 1.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A basis to start from: each pattern is used until one more bin has no piece left.

    Prices a little above proportion put large pieces first and small ones where they fill.
    Also returned: the bin that each pattern empties.  Later patterns do not hold it.
    """
    units, left = len(demand), demand.astype(float)
    price = (np.arange(1, units + 1) / units) ** power
    patterns, amount, emptied = [], [], []
    while (left > 0).any():
        pattern = best_pattern(np.where(left > 0, price, 0.0), units)[1]
        has = np.flatnonzero(pattern)
        out = int((left[has] / pattern[has]).argmin())
        times = left[has[out]] / pattern[has[out]]
        left[has] = np.maximum(left[has] - times * pattern[has], 1e-9)
        left[has[out]] = 0.0
        patterns.append(pattern), amount.append(times), emptied.append(has[out])
    return np.array(patterns), np.array(amount), np.array(emptied)


def triangular_inverse(patterns: np.ndarray, emptied: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Inverse of ``patterns[:, used].T`` by forward substitution along the emptied bins.

    Plain elementwise sums: the process of a Spark driver has forked, after which factorisations
    of a threaded linear algebra library may wait for threads that are gone.
    """
    n = len(patterns)
    lower, solved = patterns[:, emptied].T.astype(float), np.eye(n)
    for i in range(n):
        solved[i] -= (lower[i, :i, None] * solved[:i]).sum(axis=0)
        solved[i] /= lower[i, i]
    out = np.empty((n, n))
    out[:, np.searchsorted(used, emptied)] = solved
    return out


def solve_patterns(demand: np.ndarray, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often the linear program uses each.

    ``demand[i]``: pieces of ``i + 1`` units; a sequence holds ``len(demand)`` units.  It ends at
    the optimum, where no pattern prices above 1; ``rounds`` guards against cycling, with a warning:
    the plan is whole then, but may need more sequences.
    """
    units = len(demand)
    used = np.flatnonzero(demand)
    if not len(used):
        return np.zeros((0, units), np.int64), np.zeros(0)
    patterns, amount, emptied = first_patterns(demand)
    inverse = triangular_inverse(patterns, emptied, used)
    # Prices that fill a sequence by size alone are feasible and bound the optimum from below.
    center = np.zeros(units)
    center[used] = (used + 1) / units
    bound = float((center * demand).sum())
    for _ in range(rounds):
        price = np.zeros(units)
        price[used] = np.maximum(0.0, inverse.sum(axis=0))
        if amount.sum() <= bound * (1 + 1e-9):
            break
        # Columns are priced near the best bound's prices first; prices of the basis alone swing.
        for weight in (0.9, 0.0):
            mixed = weight * center + (1 - weight) * price
            value, pattern = best_pattern(mixed, units)
            worth = float((mixed * demand).sum())
            if value > 0 and worth / value > bound:
                bound, center = worth / value, mixed / value
            pattern[price <= 0] = 0  # a smaller pattern is one, too
            if (price * pattern).sum() > 1 + 1e-7:
                break
        else:
            break
        held = np.flatnonzero(pattern[used])
        move = (inverse[:, held] * pattern[used][held]).sum(axis=1)
        ratio = np.where(move > 1e-9, amount / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = max(0.0, ratio[out])
        amount = np.maximum(0.0, amount - step * move)
        amount[out] = step
        patterns[out] = pattern
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
    else:
        warnings.warn(f"the linear program was stopped after {rounds} rounds", stacklevel=2)
    return patterns, amount


@dataclass
class Plan:
    """Where the pieces of each bin go: segments of ranks, sorted by bin and first rank."""

    bin: np.ndarray
    first: np.ndarray  # rank of the segment's first piece
    slots: np.ndarray  # pieces of the bin in each of the segment's sequences
    sequence: np.ndarray  # id of the segment's first sequence
    sequences: int

    def place(self, bins: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        key = self.bin.astype(np.int64) * (1 << 44) + self.first
        k = np.searchsorted(key, bins.astype(np.int64) * (1 << 44) + ranks, side="right") - 1
        return self.sequence[k] + (ranks - self.first[k]) // self.slots[k]


def plan_sequences(demand: np.ndarray) -> Plan:
    """Whole numbers of patterns, then best fit for what they leave."""
    units = len(demand)
    patterns, amount = solve_patterns(demand.astype(float))
    times = np.floor(amount + 1e-6).astype(np.int64)
    left = demand.astype(np.int64).copy()
    lines: list[tuple[int, int, int, int]] = []  # bin, slots, first sequence, sequences
    n = 0
    for pattern, count in zip(patterns, times):
        has = np.flatnonzero(pattern)
        count = int(min(count, (left[has] // pattern[has]).min())) if len(has) else 0
        if count:
            lines += [(int(i), int(pattern[i]), n, count) for i in has]
            left -= pattern * count
            n += count
    while left.any():
        room, chosen = units, np.zeros(units, np.int64)
        for i in np.flatnonzero(left)[::-1]:
            k = min(room // (i + 1), left[i])
            chosen[i], room = k, room - k * (i + 1)
        has = np.flatnonzero(chosen)
        count = int((left[has] // chosen[has]).min())
        lines += [(int(i), int(chosen[i]), n, count) for i in has]
        left -= chosen * count
        n += count
    lines.sort(key=lambda x: (x[0], x[2]))
    first, at = [], {}
    for b, slots, _, count in lines:
        first.append(at.get(b, 0))
        at[b] = first[-1] + slots * count
    column = lambda k: np.array([x[k] for x in lines], np.int64)
    return Plan(column(0), np.array(first, np.int64), column(1), column(2), n)


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; no sequence exceeds ``capacity``."""
    cut = materialize(pieces(docs, capacity, end, files, with_ids).withColumn("bin", F.floor((F.col("length") - 1) / GRAIN).cast("int")), "pieces")
    units = -(-capacity // GRAIN)
    demand = np.zeros(units, np.int64)
    for r in cut.groupBy("bin").count().collect():  # at most one row per bin
        demand[r["bin"]] = r["count"]
    plan = plan_sequences(demand)
    salts = max(8, -(-int(demand.sum()) // PER_SALT))
    key = ["doc_id", "start", "ids_crc32", "length", "doc_tokens"]
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("bin", "salt").agg(F.count("*").alias("n")).select("bin", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("bin", "salt").orderBy(*key))).join(base, ["bin", "salt"]).withColumn("rank", (F.col("base") + F.col("nth") - 1).cast("long"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = plan.place(batch.column("bin").to_numpy(), batch.column("rank").to_numpy()) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(where, pa.int64())], names=[*columns, "sequence_id"])

    columns = [c for c in cut.columns if c != "bin"]
    schema = PIECES + ", ids binary" * with_ids + ", sequence_id long"
    sequences = ranked.select(*columns, "bin", "rank").mapInArrow(placed, schema)
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start", "ids_crc32", "doc_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return sequences.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
