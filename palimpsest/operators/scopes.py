"""Scopes: which rows a view is about, as semi-joins against key sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_union(sets: Sequence[DataFrame], key: str) -> DataFrame:
    """Distinct keys of several sets, each with its key as the first column."""
    return reduce(DataFrame.unionByName, [s.select(s[s.columns[0]].alias(key)) for s in sets]).distinct()


def in_scope(df: DataFrame, key: str, sets: Sequence[DataFrame]) -> DataFrame:
    """Rows whose key is in any set: one semi-join against the union, so no row is copied."""
    return df.join(key_union(sets, key), key, "left_semi")


def in_either_scope(df: DataFrame, keys: dict[str, Sequence[DataFrame]], row_id: str) -> DataFrame:
    """Rows in scope by any of several different keys.

    Each key gets its own equi semi-join; the row ids they find are united.  (An OR of
    two keys in one join would be a nested loop.)
    """
    found = reduce(DataFrame.unionByName, [in_scope(df.select(row_id, k), k, s).select(row_id) for k, s in keys.items()])
    return df.join(found.distinct(), row_id, "left_semi")


def outside(df: DataFrame, keys: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows without a partner; null keys have none."""
    return df.join(keys, on, "left_anti")


def flagged(df: DataFrame, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Adds whether the key is in the set."""
    return df.join(keys.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def time_window(column: Column, start: str, end: str, half_open: bool = True) -> Column:
    """``start <= t < end``, or ``start < t`` for feeds that continue after a mark."""
    if half_open:
        return (column >= F.lit(start).cast("timestamp_ntz")) & (column < F.lit(end).cast("timestamp_ntz"))
    return column > F.lit(start).cast("timestamp_ntz")


def window_bounds(name: str, as_of: str, first: str | None = None, last: str | None = None) -> tuple[str, str]:
    """Bounds of a named window that ends a second after ``as_of``, or of given days (366 at most)."""
    from datetime import datetime, timedelta

    now = datetime.fromisoformat(as_of)
    spans = {"24h": timedelta(hours=24), "7d": timedelta(days=7), "30d": timedelta(days=30)}
    if name in spans:
        return str(now - spans[name]), str(now + timedelta(seconds=1))
    if name != "custom" or not first or not last:
        raise ValueError("a custom window needs two days")
    a, b = datetime.fromisoformat(first), datetime.fromisoformat(last) + timedelta(days=1)
    if not a < b or (b - a).days > 366:
        raise ValueError("a window has 1 to 366 days")
    return str(a), str(b)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, value: str, tie: str) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before its time, per key; null before the first.

    Both sides are one sorted stream per key, so nothing is joined by a range; of rows of ``right``
    at one time the one with the largest ``tie`` counts.
    """
    rest = [c for c in left.columns if c not in (*keys, ts)]
    a = left.select(*keys, ts, F.struct(*rest).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), F.lit(1).alias("__side"))
    b = right.filter(F.col(value).isNotNull()).select(*keys, ts, F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"), F.col(tie).alias("__tie"), F.lit(0).alias("__side"))
    w = Window.partitionBy(*keys).orderBy(ts, "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("__last", F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
    return found.select(*keys, ts, "__row.*", F.col("__last").alias(value))
