"""Interaction of five document filters, by direct replay of every order.

Every document gets the five failure flags and its two labels.  Documents that share part,
flags and labels are counted first (with map-side combining); these counted flag rows are
crossed with the 120 broadcast orders and exploded into five steps.  The first filter that
fails in an order removes the row there, and conditional sums per part, order and step
give the report.  A row of the report is a sum over flag rows, so it does not depend on how
they were gathered.

Copies are found by the SHA-256 of the text.  Documents are counted per digest and doc_id
first, so a group of copies never meets in one task: a digest's rows are combined down to one
per part and labels before its smallest doc_id is looked up.

Defined results.  Null texts and sources are empty strings; an empty text fails filter A and,
where a smaller doc_id has one, E.  B needs a word to fail.  Repeated rows of one doc_id are
documents of their own and not copies of each other; a null doc_id is no smaller id, has no
label and never fails E.  A doc_id with several labels is good or toxic if one of them says so.
An empty table has no parts and no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import discard, materialize

FILTERS = "ABCDE"
_BLANK = r"[\x20\x09-\x0D]+"
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def failure_flags(text: Column) -> dict[str, Column]:
    """Flags A to D of a text, E belongs to the whole table."""
    words = F.array_remove(F.split(text, _BLANK), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flag_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, A, B, C, D, E, good, toxic, n)``: documents per part, flags and labels."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flags = failure_flags(F.col("body"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("body"))
    flagged = plain.select("doc_id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), *[f.alias(name) for name, f in flags.items()])
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marked = flagged.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    like = ["digest", "part", *flags, "good", "toxic"]
    by_id = marked.groupBy(*like, "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    groups = materialize(by_id.groupBy(*like).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), first), "digests")
    # a digest of one group needs no lookup
    several = groups.groupBy("digest").agg(F.count("*").alias("groups"), F.min("first.doc_id").alias("lowest")).filter("groups > 1").select("digest", "lowest")
    own = F.when(F.col("lowest").isNull() | (F.col("first.doc_id") == F.col("lowest")), F.coalesce("first.n", F.lit(0))).otherwise(0)
    counted = groups.join(several, "digest", "left").withColumn("leading", F.col("nameless") + own)
    sides = F.array(F.struct(F.lit(False).alias("E"), F.col("leading").alias("m")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("leading")).alias("m")))
    split = counted.select("part", *flags, "good", "toxic", F.explode(sides).alias("x"))
    counts = materialize(split.groupBy("part", *flags, F.col("x.E").alias("E"), "good", "toxic").agg(F.sum("x.m").alias("n")).filter("n > 0"), "flag_counts")
    discard(groups)
    return counts


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """``(filter_order)``: every order of the filters, 120 rows."""
    return spark.createDataFrame([("".join(p),) for p in permutations(filters)], "filter_order string")


def replay(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The report of counted flag rows: per part, order and step what the step's filter did."""
    fails = F.create_map(*[x for f in filters for x in (F.lit(f), F.col(f))])
    rows = counts.select("part", "good", "toxic", "n", fails.alias("fails"), sum(F.col(f).cast("int") for f in filters).alias("n_fails"))
    crossed = rows.crossJoin(F.broadcast(orders(counts.sparkSession, filters)))
    letters = F.sequence(F.lit(1), F.lit(len(filters)))
    failing = F.filter(letters, lambda k: F.col("fails")[F.substring("filter_order", k, F.lit(1))])
    steps = crossed.withColumn("first", F.coalesce(F.array_min(failing), F.lit(len(filters) + 1))).withColumn("step", F.explode(letters))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    here, fails_here = F.col("first") == F.col("step"), F.col("fails")[letter]
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long")
    sums = {
        "kept": F.col("first") > F.col("step"),
        "removed": here,
        "redundant": fails_here & (F.col("first") < F.col("step")),
        "unique_fails": fails_here & (F.col("n_fails") == 1),
        "good_lost": here & F.col("good"),
        "toxic_lost": here & F.col("toxic"),
    }
    return steps.groupBy("part", "filter_order", "step").agg(*[total(c).alias(name) for name, c in sums.items()])


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``."""
    filter_of_step = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))  # 120 rows each
    report = replay(flag_counts(docs, labels)).withColumn("shapley", F.sum("removed").over(filter_of_step).cast("long"))
    return report.select("part", "filter_order", F.col("step").cast("int").alias("step"), *_COUNTS, "shapley")


FILTER_SQL = r"""
WITH labelled AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), flags AS (
  SELECT s.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 200 AS fa, 100 * len(list_distinct(w)) < 50 * len(w) AS fb,
         100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) AS fc, regexp_matches(body, '[#$%&*|]') AS fd,
         coalesce(s.doc_id > min(s.doc_id) OVER (PARTITION BY body), false) AS fe
  FROM split s LEFT JOIN labelled l ON s.doc_id = l.doc_id
), counted AS (
  SELECT part, map(['A', 'B', 'C', 'D', 'E'], [fa, fb, fc, fd, fe]) AS fails, CAST(fa AS INT) + CAST(fb AS INT) + CAST(fc AS INT) + CAST(fd AS INT) + CAST(fe AS INT) AS n_fails,
         good, toxic, count(*) AS n FROM flags GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), placed AS (
  SELECT part, filter_order, fails, n_fails, good, toxic, n,
         coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda k: fails[filter_order[k]])), 6) AS first FROM counted, orders
), stepped AS (
  SELECT *, fails[filter_order[step]] AS bad FROM placed, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), report AS (
  SELECT part, filter_order, step, sum(CASE WHEN first > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN first = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN bad AND first < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bad AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN first = step AND good = 1 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN first = step AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM stepped GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM report
"""
