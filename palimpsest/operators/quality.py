"""Data-quality and integrity audits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import LISTED, first_members

#: Texts that count as missing.
EMPTY = ("", "-", "[]")


def covered(column: Column) -> Column:
    return column.isNotNull() & ~F.trim(column.cast("string")).isin(*EMPTY)


def coverage_matrix(df: DataFrame, group: Sequence[Column], fields: dict[str, Column]) -> DataFrame:
    """Rows and covered rows per group and field, one pass."""
    return df.groupBy(*group).agg(F.count("*").alias("total"), *[F.count_if(covered(c)).alias(n) for n, c in fields.items()])


def missing_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field_name, missing, total)``."""
    one = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(f).isNull()).alias(f) for f in fields])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("missing"), F.col("total")) for f in fields])).alias("x")).select("x.*")


def _equal(keys: Sequence[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of keys that several rows have, with the number ``n``: a group's members as a table."""
    several = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return df.alias("r").join(several.alias("s"), _equal(keys, "r", "s")).select("r.*", "s.n")


def duplicate_keys(df: DataFrame, keys: Sequence[str], ids: Column, separator: str = ",", most: int = LISTED) -> DataFrame:
    """Keys of several rows, with their number and the first ``most`` ids in order."""
    rows = duplicate_rows(df.select(*keys, ids.alias("id")), keys)
    listed = first_members(rows, [*keys, "n"], F.col("id"), most)
    return listed.select(*keys, "n", F.array_join(F.transform("members", lambda x: x.cast("string")), separator).alias("ids"))


def several_partners(df: DataFrame, key: Sequence[str], partner: str, most: int = LISTED) -> DataFrame:
    """Keys linked with more than one partner, with their number and the first ``most`` partners."""
    links = df.select(*key, F.col(partner).alias("partner")).filter("partner is not null").distinct()
    counts = links.groupBy(*key).agg(F.count("*").alias("n_partners")).filter("n_partners > 1")
    listed = first_members(links, key, F.col("partner"), most)
    joined = counts.alias("c").join(listed.alias("l"), _equal(key, "c", "l"))
    return joined.select(*[F.col(f"c.{k}").alias(k) for k in key], "n_partners", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("partners"))


def orphans(child: DataFrame, parent: DataFrame, on: dict[str, str], code: str, severity: str = "error") -> DataFrame:
    """``(severity, code, n)``: child rows whose parent is missing."""
    cond = reduce(lambda a, b: a & b, [child[c] == parent[p] for c, p in on.items()])
    return child.join(parent, cond, "left_anti").agg(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.count("*").alias("n"))


def broken_rule(df: DataFrame, rule: Column, code: str, severity: str = "error") -> DataFrame:
    """``(severity, code, n)``: rows that break a rule."""
    return df.agg(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.count_if(rule).alias("n"))


def audit(checks: Sequence[DataFrame]) -> DataFrame:
    """All checks as one table."""
    return reduce(DataFrame.unionByName, checks)


def audit_status(checks: DataFrame) -> DataFrame:
    """One row: ``status`` by the gravest check that found something."""
    bad = lambda s: F.count_if((F.col("severity") == s) & (F.col("n") > 0))
    return checks.agg(F.when(bad("error") > 0, "error").when(bad("warning") > 0, "warning").otherwise("ok").alias("status"))


def funnel(df: DataFrame, group: Sequence[Column], state: str, done: str, closed: Sequence[str]) -> DataFrame:
    """Counts per state and the share of the closed ones that were done."""
    counts = df.groupBy(*group).agg(*[F.count_if(F.col(state) == s).alias(s) for s in closed])
    return counts.withColumn("conversion", F.try_divide(F.col(done), reduce(lambda a, b: a + b, [F.col(s) for s in closed])))


def confidence_histogram(df: DataFrame, value: Column, bounds: Sequence[float]) -> DataFrame:
    """Left-closed buckets."""
    out = F.lit(f">={bounds[-1]:.2f}")
    for i in range(len(bounds) - 1, 0, -1):
        out = F.when(value < bounds[i], f"{bounds[i - 1]:.2f}-{bounds[i]:.2f}").otherwise(out)
    return df.groupBy(F.when(value < bounds[0], f"<{bounds[0]:.2f}").otherwise(out).alias("bucket")).agg(F.count("*").alias("n"))


def payload_size(df: DataFrame, group: Sequence[str], payload: str) -> DataFrame:
    """Characters of payload per group, beside those of all."""
    per = df.groupBy(*group).agg(F.sum(F.length(payload)).alias("chars"), F.count("*").alias("n"))
    # a row per group is left, so their sum needs no second scan of the payloads
    whole = per.agg(F.sum("chars").cast("long").alias("all_chars")).withColumn("__one", F.lit(1))
    return per.withColumn("__one", F.lit(1)).join(whole, "__one").drop("__one")


def canary(text: Column, labels: Sequence[str], least: int) -> Column:
    """At least so many of the labels occur in a page."""
    return reduce(lambda a, b: a + b, [F.when(text.contains(x), 1).otherwise(0) for x in labels]) >= least


def false_merges(records: DataFrame, master: str, sets: Sequence[str], id_col: str) -> DataFrame:
    """Masters whose records differ in a listed column, or in the alphabetic prefix of their id."""
    prefix = F.regexp_extract(F.col(id_col).cast("string"), r"^([A-Za-z]*)", 1)
    names = [*sets, "prefixes"]
    at = range(len(names))
    rows = records.select(F.col(master).alias("master"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(sets)], prefix.alias(f"c{len(sets)}"))
    # equal rows meet first, so a large master is few rows when its own meet in one task
    alike = rows.groupBy("master", *[f"c{i}" for i in at]).agg(F.count("*").alias("n")).repartition("master")
    # a row per column with its values alone; columns keep their types
    each = [F.struct(F.lit(i).alias("at"), *[(F.struct(F.col(f"c{j}").alias("v")) if i == j else F.lit(None)).alias(f"v{j}") for j in at], F.col("n").alias("n")) for i in at]
    held = alike.select("master", F.explode(F.array(*each)).alias("x")).select("master", "x.*").groupBy("master", "at", *[f"v{j}" for j in at]).agg(F.sum("n").alias("n"))
    known = [(F.col("at") == i) & F.col(f"v{i}.v").isNotNull() for i in range(len(names))]
    agg = held.groupBy("master").agg(F.sum(F.when(F.col("at") == 0, F.col("n"))).alias("n_records"), *[F.count_if(k).alias(f"n_{c}") for k, c in zip(known, names)]).withColumnRenamed("master", master)
    return agg.filter((F.col("n_records") > 1) & reduce(lambda a, b: a | b, [F.col(f"n_{c}") > 1 for c in names]))


def ratio_outliers(records: DataFrame, master: str, value: str, ratio: float) -> DataFrame:
    """Masters whose largest value is at least ``ratio`` times the smallest."""
    agg = records.groupBy(master).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n_records"))
    return agg.filter((F.col("n_records") > 1) & (F.col("low") > 0) & (F.col("high") >= ratio * F.col("low")))
