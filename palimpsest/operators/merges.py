"""Missed merges: evidence that records belong to one master and don't, as one table.

Four kinds of evidence, each with its own blocking:

* ``high_title_similarity``: an unlinked record and a master of which a record has a title of
  ``ratio`` or more.  Equal titles are one group, so copies cost a row each.
* ``cross_language_title``: two records of one source whose titles are in different scripts and that
  share ``least`` keys (numbers, codes, dates: what both languages write alike).  A pair with so many
  common keys shares one of the rarest of each record, so frequent keys make no pairs by themselves.
  Records alike in source, script, master and keys are one class; classes are compared, and
  ``cross_language_classes`` returns pairs of classes and their members (``cross_language_member``).
* ``same_protocol_diff_master``: a protocol number of several masters, the smallest with each other one.
* ``enrollment_discrepancy``: a master's smallest number of participants against each of its records
  with ``factor`` times as many.

``(issue, a, b, score, detail)``: ``a`` and ``b`` as text.  Null titles, keys and protocols are no
evidence; numbers that are null or not above 0 neither.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import audit
from .resolve import similar_titles

#: Fixed values of the checks: least title ratio, and ratio of participants that is a discrepancy.
TITLE_RATIO, FACTOR = 0.92, 1.5


def _evidence(rows: DataFrame, issue: str, a: Column, b: Column, score: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(issue).alias("issue"), a.cast("string").alias("a"), b.cast("string").alias("b"), score.cast("double").alias("score"), detail.cast("string").alias("detail"))


def title_evidence(records: DataFrame, record: str, title: str, master: str, ratio: float = TITLE_RATIO) -> DataFrame:
    """Unlinked records (null ``master``) with each master that has a similar title; ``score``: the best ratio."""
    rows = records.select(F.col(record).alias("rec"), F.lower(F.col(title).cast("string")).alias("t"), F.col(master).alias("m")).filter("t is not null")
    groups = rows.groupBy("t").agg(F.min("rec").alias("rep"))
    near = similar_titles(groups, "rep", "t", ratio).select("a", "b", "ratio")
    # every group is like itself; links hold in both directions
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "ratio")).unionByName(groups.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("ratio")))
    held = rows.join(groups, "t")
    masters = held.filter("m is not null").select(F.col("rep").alias("b"), "m").distinct()
    reached = both.join(masters, "b").groupBy("a", "m").agg(F.max("ratio").alias("ratio"))
    found = held.filter("m is null").select("rec", F.col("rep").alias("a"), "t").join(reached, "a")
    return _evidence(found, "high_title_similarity", F.col("rec"), F.col("m"), F.round("ratio", 4), F.substring("t", 1, 60))


def _keyed_classes(records: DataFrame, record: str, source: str, other_script: Column, keys: Column, master: str | None, least: int) -> tuple[DataFrame, DataFrame]:
    """Records with ``least`` keys as ``(source, other, m, ks, rec)``, and their classes, alike in all but ``rec``: named by their smallest record."""
    own = F.col(master) if master else F.lit(None).cast("string")
    rows = records.select(F.col(record).alias("rec"), F.col(source).alias("source"), other_script.alias("other"), own.alias("m"), F.array_sort(F.array_compact(F.array_distinct(keys))).alias("ks")).filter((F.size("ks") >= least) & F.col("rec").isNotNull())
    return rows, rows.groupBy("source", "other", "m", "ks").agg(F.min("rec").alias("rep"))


def _class_pairs(classes: DataFrame, least: int) -> DataFrame:
    """``(a, b, common)``: classes of one source in different scripts, not of one master, that share ``least`` keys."""
    long = classes.select("rep", "source", "other", "m", F.size("ks").alias("n"), F.explode("ks").alias("k"))
    often = long.groupBy("source", "k").agg(F.count("*").alias("df"), F.count_if("other").alias("n_other")).filter("n_other > 0 and n_other < df")
    ranked = long.join(often, ["source", "k"], "left").withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy(F.coalesce("df", F.lit(0)), "k")))
    # keys of one script alone match nothing, but they count towards the rarest
    front = ranked.filter((F.col("nth") <= F.col("n") - least + 1) & F.col("df").isNotNull())
    side = lambda of, name: front.filter(of).select("source", "k", F.col("rep").alias(name), F.col("m").alias(f"m_{name}"))
    apart = ~F.coalesce(F.col("m_a") == F.col("m_b"), F.lit(False))
    pairs = side("other", "a").join(side("not other", "b"), ["source", "k"]).filter(apart).select("a", "b").distinct()
    held = lambda name: classes.select(F.col("rep").alias(name), F.col("ks").alias(f"ks_{name}"))
    common = F.array_sort(F.array_intersect("ks_a", "ks_b"))
    return pairs.join(held("a"), "a").join(held("b"), "b").select("a", "b", common.alias("common")).filter(F.size("common") >= least)


def _shared_keys(pairs: DataFrame, a: Column, b: Column) -> DataFrame:
    return _evidence(pairs, "cross_language_title", F.least(a, b), F.greatest(a, b), F.size("common"), F.array_join(F.slice("common", 1, 5), ","))


def cross_language_evidence(records: DataFrame, record: str, source: str, other_script: Column, keys: Column, master: str | None = None, least: int = 2) -> DataFrame:
    """Pairs of one source in different scripts that share ``least`` of ``keys`` (array of text), not of one master.

    All pairs of records: two classes of ``n`` and ``m`` copies give ``n * m`` rows, ``cross_language_classes`` one and the members.
    """
    rows, classes = _keyed_classes(records, record, source, other_script, keys, master, least)
    members = _members(rows, classes)
    side = lambda name: members.select(F.col("rep").alias(name), F.col("rec").alias(f"rec_{name}"))
    return _shared_keys(_class_pairs(classes, least).join(side("a"), "a").join(side("b"), "b"), F.col("rec_a"), F.col("rec_b"))


def cross_language_classes(records: DataFrame, record: str, source: str, other_script: Column, keys: Column, master: str | None = None, least: int = 2) -> DataFrame:
    """The pairs of ``cross_language_evidence`` by classes of records of one source, script, master and set of keys.

    ``cross_language_title``: pairs of classes, each by its smallest record.  ``cross_language_member``: the
    other records ``b`` of each class ``a`` in such a pair; ``score``: the number of their keys.
    """
    rows, classes = _keyed_classes(records, record, source, other_script, keys, master, least)
    pairs = _class_pairs(classes, least)
    linked = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    copies = _members(rows, classes).join(linked, "rep", "left_semi").filter("rec > rep")
    listed = _evidence(copies, "cross_language_member", F.col("rep"), F.col("rec"), F.size("ks"), F.array_join(F.slice("ks", 1, 5), ","))
    return _shared_keys(pairs, F.col("a"), F.col("b")).unionByName(listed)


def _members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``(rep, rec, ks)``: every record of a class."""
    same = F.col("r.source").eqNullSafe(F.col("c.source")) & F.col("r.other").eqNullSafe(F.col("c.other")) & F.col("r.m").eqNullSafe(F.col("c.m")) & (F.col("r.ks") == F.col("c.ks"))
    return rows.alias("r").join(classes.alias("c"), same).select("c.rep", "r.rec", "r.ks")


def protocol_evidence(identifiers: DataFrame, masters: DataFrame, record: str) -> DataFrame:
    """Protocol numbers of several masters: the smallest master with each other one; ``score``: how many there are."""
    held = identifiers.filter("type = 'ProtocolNumber' and value is not null").select(record, "value").join(masters.select(record, "master"), record).select("value", "master").distinct()
    several = held.groupBy("value").agg(F.min("master").alias("low"), F.count("*").alias("n")).filter("n > 1")
    return _evidence(held.join(several, "value").filter("master > low"), "same_protocol_diff_master", F.col("low"), F.col("master"), F.col("n"), F.col("value"))


def enrollment_evidence(records: DataFrame, record: str, master: str, number: str, factor: float = FACTOR) -> DataFrame:
    """Records of a master with ``factor`` times the smallest number of its records; ``score``: the ratio."""
    rows = records.filter((F.col(number) > 0) & F.col(master).isNotNull()).select(F.col(record).alias("rec"), F.col(master).alias("m"), F.col(number).alias("x"))
    low = rows.groupBy("m").agg(F.min(F.struct("x", "rec")).alias("low"))
    far = rows.join(low, "m").filter(F.col("x") >= factor * F.col("low.x"))
    return _evidence(far, "enrollment_discrepancy", F.col("low.rec"), F.col("rec"), F.col("x") / F.col("low.x"), F.col("m"))


def missed_merges(parts: Sequence[DataFrame]) -> DataFrame:
    """All evidence as one table."""
    return audit(parts)
