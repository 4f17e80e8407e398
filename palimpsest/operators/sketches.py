"""Approximate aggregates that are stored per day and merged over any window.

A sketch table has a row per day and group: a HyperLogLog of the distinct values, a KLL sketch of a
number, and a plain count.  Rows are some kilobytes whatever the day held, so a window over years
reads sketches and no events.  A count-min sketch is a plain table of cells, which add up.

Errors.  A HyperLogLog of ``lg`` bits has a relative standard error of ``hll_error(lg)``.  The rank of
a KLL quantile of size ``k`` is off by ``kll_error(k)`` of the rows, with 99 % confidence.  A
count-min estimate is never too low; it is too high by more than ``e / width`` of all rows with a
probability of ``exp(-depth)``.

Null values are counted as rows and enter no sketch.  A group of nulls alone has null sketches, no
distinct values and no quantile.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG, KLL = 12, 200


def hll_error(lg: int = LG) -> float:
    """Relative standard error of a merged HyperLogLog estimate."""
    return 1.04 / math.sqrt(2**lg)


def kll_error(k: int = KLL) -> float:
    """Rank error of a KLL quantile, as a share of the rows, at 99 % confidence."""
    return 2.296 / k**0.9021


def daily_sketches(rows: DataFrame, day: Column, keys: Sequence[str], distinct: str, number: str, lg: int = LG, k: int = KLL) -> DataFrame:
    """``(day, keys, n, uniques, spread)``: count, distinct values and distribution of a day."""
    return rows.groupBy(day.alias("day"), *keys).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(distinct, F.lit(lg)).alias("uniques"),
        F.kll_sketch_agg_double(F.col(number).cast("double"), F.lit(k)).alias("spread"),
    )


def store_days(sketches: DataFrame, path: str) -> None:
    """Write whole days; a day written again replaces the one before, other days stay."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The stored days from ``first`` to ``last``; other days' files are not read."""
    day = F.col("day").cast("date")
    return spark.read.parquet(path).filter(day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))).withColumn("day", day)


def merge_sketches(sketches: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Sketches of larger groups, with the columns of ``daily_sketches``."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("uniques").alias("uniques"), F.kll_merge_agg_double("spread").alias("spread"))


def trailing(sketches: DataFrame, days: int) -> DataFrame:
    """Every day's sketches once per trailing window of ``days`` days that holds it, as ``window_end``.

    Windows end on the days from the first to the last one of the table.
    """
    last = sketches.agg(F.max("day").alias("last_day"))
    ends = F.sequence("day", F.least(F.date_add("day", days - 1), "last_day"))
    return sketches.crossJoin(F.broadcast(last)).withColumn("window_end", F.explode(ends)).drop("last_day")


def estimates(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The sketches read: ``n``, ``n_distinct`` and a column per quantile take their place."""
    keep = [c for c in sketches.columns if c not in ("n", "uniques", "spread")]
    held = F.coalesce(F.kll_sketch_get_n_double("spread"), F.lit(0)) > 0
    read = {name: F.when(held, F.kll_sketch_get_quantile_double("spread", F.lit(q))) for name, q in quantiles.items()}
    return sketches.select(*keep, "n", F.coalesce(F.hll_sketch_estimate("uniques"), F.lit(0)).alias("n_distinct"), *[c.alias(name) for name, c in read.items()])


def _cell(value: Column, row: Column, width: int) -> Column:
    """The cell of a value in a row of a count-min sketch: 32 bits of an MD5, modulo ``width``."""
    digest = F.md5(F.concat_ws("|", row.cast("string"), value.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(width)).cast("int")


def count_min(rows: DataFrame, keys: Sequence[str], value: str, width: int = 256, depth: int = 4) -> DataFrame:
    """``(keys, row, cell, n)``: a count-min sketch per group; at most ``width * depth`` rows each."""
    every = F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row")
    # equal values are counted before they are dealt to cells
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("times"))
    return counts.select(*keys, value, "times", every).groupBy(*keys, "row", _cell(F.col(value), F.col("row"), width).alias("cell")).agg(F.sum("times").alias("n"))


def merge_count_min(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of larger groups: cells add up."""
    return cells.groupBy(*keys, "row", "cell").agg(F.sum("n").alias("n"))


def count_min_estimates(cells: DataFrame, keys: Sequence[str], asked: DataFrame, value: str, width: int = 256, depth: int = 4) -> DataFrame:
    """``(keys, value, estimate)`` of the asked values: the smallest of a value's cells, 0 where one is empty.

    ``asked`` holds ``keys`` and ``value``, each pair once.
    """
    rows = asked.select(*keys, value, F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row")).withColumn("cell", _cell(F.col(value), F.col("row"), width))
    read = rows.join(cells, [*keys, "row", "cell"], "left")
    return read.groupBy(*keys, value).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
