"""Version chains: numbering, unchanged-version skipping, latest rows, streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(columns: Sequence[str | Column]) -> Column:
    """SHA-256 over the values as text, nulls told apart from empty strings."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def _window(keys: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def skip_unchanged(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], tracked: Sequence[str]) -> DataFrame:
    """Rows whose tracked columns differ from the row before them."""
    state = F.struct(*[F.col(c) for c in tracked])
    w = _window(keys, order)
    return df.withColumn("__before", F.lag(state).over(w)).withColumn("__nth", F.row_number().over(w)).filter((F.col("__nth") == 1) | ~state.eqNullSafe(F.col("__before"))).drop("__before", "__nth")


def version_chain(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], id_col: str) -> DataFrame:
    """Adds ``version_number`` (from 1), ``is_latest`` and ``superseded_by`` (the next row's id)."""
    w = _window(keys, order)
    after = F.lead(id_col).over(w)
    return df.withColumns({"version_number": F.row_number().over(w), "superseded_by": after, "is_latest": after.isNull()})


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; an aggregation, so that it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*keys, *[F.col(f"__last.{c}").alias(c) for c in rest]).select(*df.columns)


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key (first writer wins)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")).select(*keys, *[F.col(f"__first.{c}").alias(c) for c in rest]).select(*df.columns)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key, with their rank."""
    return df.withColumn(rank, F.row_number().over(_window(keys, order))).filter(F.col(rank) <= k)


def lifetimes(df: DataFrame, keys: Sequence[str], first: str, last: str) -> DataFrame:
    """When each key was first seen and last changed."""
    return df.groupBy(*keys).agg(F.min(first).alias("first_seen"), F.max(last).alias("last_changed"))


def failure_streaks(runs: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column) -> DataFrame:
    """Adds ``streak``: failures in a row up to and with this run (0 after a success)."""
    w = _window(keys, order)
    run = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    return runs.withColumn("__island", run).withColumn("streak", F.sum(F.when(failed, 1).otherwise(0)).over(_window([*keys, "__island"], order))).drop("__island")


def version_pairs(versions: DataFrame, keys: Sequence[str], low: int, high: int, fields: Sequence[str], version: str = "version_number") -> DataFrame:
    """Two chosen versions of each key side by side: ``<field>_from`` and ``<field>_to``."""
    a = versions.filter(F.col(version) == low).select(*keys, *[F.col(f).alias(f"{f}_from") for f in fields])
    b = versions.filter(F.col(version) == high).select(*keys, *[F.col(f).alias(f"{f}_to") for f in fields])
    return a.join(b, list(keys))


#: Members of a group that are listed; counts cover all of them.
LISTED = 50


def first_members(rows: DataFrame, keys: Sequence[str], member: Column, most: int = LISTED) -> DataFrame:
    """``(keys, members)``: the first ``most`` members of each key, in order.

    A rank within the limit is cut before the shuffle, too, so a hot key brings ``most`` rows per task.
    """
    ranked = rows.select(*keys, member.alias("member")).withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("member"))).filter(F.col("nth") <= most)
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "member"))), lambda x: x["member"]).alias("members"))
