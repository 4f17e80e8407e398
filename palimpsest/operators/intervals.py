"""Joins of intervals with intervals by buckets of their range.

Half-open intervals ``[start, end)`` of numbers are dealt to the buckets of ``width`` they touch; only
intervals of one bucket are compared.  A pair that shares several buckets is found in the first of
them alone, so nothing has to be deduplicated.  Rows of a bucket that holds more than ``most`` left
rows are dealt to parts: left rows by hash, right rows to every part, so a hot bucket is many tasks
and no pair is lost.

Null bounds and empty intervals (``end <= start``) meet nothing.  Repeated rows give repeated pairs.
Intervals that are much longer than ``width`` give many rows: choose ``width`` near the usual length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dealt(rows: DataFrame, on: Sequence[str], start: Column, end: Column, width: float, side: str) -> DataFrame:
    """The rows packed as ``side``, once per bucket, with their bounds and keys."""
    bucket = lambda x: F.floor(x / width).cast("long")
    packed = rows.select(F.struct("*").alias(side), start.cast("double").alias("from"), end.cast("double").alias("to"), *[F.col(c).alias(f"key{i}") for i, c in enumerate(on)])
    real = packed.filter(F.col("to") > F.col("from")).withColumn("first", bucket(F.col("from")))
    last = F.greatest(F.col("first"), F.ceil(F.col("to") / width).cast("long") - 1)
    return real.withColumn("bucket", F.explode(F.sequence("first", last)))


def overlap_join(left: DataFrame, right: DataFrame, bounds: tuple[Column, Column], other: tuple[Column, Column], width: float, on: Sequence[str] = (), most: int = 100_000) -> DataFrame:
    """``(l, r)``: structs of the rows of both sides whose intervals overlap and whose ``on`` columns are equal.

    ``bounds`` and ``other``: start and end of the left and of the right side.
    """
    keys = [f"key{i}" for i in range(len(on))]
    a = _dealt(left, on, *bounds, width, "l").withColumnsRenamed({"from": "l_from", "to": "l_to", "first": "l_first"})
    b = _dealt(right, on, *other, width, "r").withColumnsRenamed({"from": "r_from", "to": "r_to", "first": "r_first"})
    place = [*keys, "bucket"]
    hot = a.groupBy(*place).agg(F.count("*").alias("held")).filter(F.col("held") > most).select(*place, F.ceil(F.col("held") / most).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    a = a.join(hot, place, "left").withColumn("part", F.pmod(F.xxhash64("l_from", "l_to", F.monotonically_increasing_id()), parts).cast("int")).drop("parts")
    b = b.join(hot, place, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    met = a.join(b, [*place, "part"])
    overlap = (F.col("l_from") < F.col("r_to")) & (F.col("r_from") < F.col("l_to"))
    return met.filter(overlap & (F.col("bucket") == F.greatest("l_first", "r_first"))).select("l", "r")


def point_join(points: DataFrame, ranges: DataFrame, at: Column, bounds: tuple[Column, Column], width: float, on: Sequence[str] = (), most: int = 100_000) -> DataFrame:
    """``(l, r)``: points with the intervals that hold them."""
    # a point is in one bucket; an interval of no length would be empty, so it ends at the next number
    just_after = F.when(at == 0, F.lit(5e-324)).otherwise(at.cast("double") + F.abs(at.cast("double")) * F.lit(2.3e-16))
    found = overlap_join(points.withColumn("point", at.cast("double")), ranges, (at.cast("double"), just_after), bounds, width, on, most)
    low, high = bounds
    return found.filter(F.col("l.point").isNotNull()).select(F.col("l").dropFields("point").alias("l"), "r")
