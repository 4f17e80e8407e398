"""Windowed aggregates over scoped events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from .versions import LISTED, first_members


def totals(events: DataFrame, entity: str) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.count_distinct(entity).alias("entities"))


def histogram(events: DataFrame, column: Column, name: str, default: str) -> DataFrame:
    return events.groupBy(F.coalesce(column, F.lit(default)).alias(name)).agg(F.count("*").alias("n"))


def daily_trend(events: DataFrame, ts: str, series: str, values: Sequence[str]) -> DataFrame:
    """A row per day, a column per known value of the series."""
    return events.groupBy(F.to_date(ts).alias("day")).agg(*[F.count_if(F.col(series) == v).alias(v) for v in values])


def dense_calendar(daily: DataFrame, day: str, first: str, last: str, counts: Sequence[str]) -> DataFrame:
    """Every day from first to last, zeros where nothing happened."""
    days = daily.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(day))
    return days.join(daily, day, "left").select(day, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def transition_matrix(changes: DataFrame, old: str, new: str, entity: str) -> DataFrame:
    return changes.groupBy(F.col(old).alias("from_value"), F.col(new).alias("to_value")).agg(F.count("*").alias("n"), F.count_distinct(entity).alias("entities"))


def entity_activity(events: DataFrame, entity: str, ts: str, rank: Column, k: int) -> DataFrame:
    """The busiest entities: events, highest rank, latest event; ties by entity."""
    per = events.groupBy(entity).agg(F.count("*").alias("n_events"), F.max(rank).alias("top_rank"), F.max(ts).alias("last_event"))
    return per.orderBy(F.desc("n_events"), entity).limit(k)


def conditional_distinct(df: DataFrame, group: Sequence[Column], entity: Column, conditions: dict[str, Column]) -> DataFrame:
    """Distinct entities that meet each condition."""
    return df.groupBy(*group).agg(*[F.count_distinct(F.when(c, entity)).alias(n) for n, c in conditions.items()])


def numeric_deltas(changes: DataFrame, old: str, new: str) -> DataFrame:
    """Adds ``delta`` and ``percent``; null where a value is no number or the old one is 0."""
    a, b = F.col(old).try_cast("double"), F.col(new).try_cast("double")
    return changes.withColumns({"delta": b - a, "percent": F.when(a != 0, (b - a) / F.abs(a) * 100)})


def list_diff(old: Column, new: Column) -> tuple[Column, Column]:
    """Added and removed items, sorted."""
    return F.array_sort(F.array_except(new, old)), F.array_sort(F.array_except(old, new))


def freshness(seen: DataFrame, source: str, last: str, as_of: str, cadence_hours: Column, disabled: Column | None = None) -> DataFrame:
    """Adds ``age_hours`` and ``state`` (fresh, delayed, stale, unknown, disabled)."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(last).cast("timestamp"))
    hours = age / 3600.0
    state = F.when(F.lit(False) if disabled is None else disabled, "disabled").when(F.col(last).isNull(), "unknown").when(hours <= cadence_hours + 6, "fresh").when(hours <= cadence_hours * 3, "delayed").otherwise("stale")
    return seen.withColumns({"age_hours": hours, "state": state})


def disagreements(records: DataFrame, master: str, source: str, fields: Sequence[str]) -> DataFrame:
    """Fields of which the sources of one master hold different values."""
    long = records.select(master, source, F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select(master, source, "x.*")
    agg = long.groupBy(master, "field_name").agg(F.count_distinct(source).alias("n_sources"), F.count_distinct("value").alias("n_values"))
    return agg.filter("n_sources >= 2 and n_values > 1")


def conflict_values(records: DataFrame, master: str, source: str, fields: Sequence[str]) -> DataFrame:
    """``(master, field_name, value, n_sources, first_source)``: the values of fields that a master's sources disagree about.

    A row per value, so a master costs as many rows as it has values; ``conflict_counts`` has the pairs of sources.
    """
    held = _by_master(records, master, source, fields).select("m", "s", _fields(fields)).select("m", "s", "x.*").filter("v is not null and s is not null")
    # all groups are parts of a master's rows, which stand in one task
    values = held.groupBy("m", "field_name", "v").agg(F.count_distinct("s").alias("n_sources"), F.min("s").alias("first_source"), F.max("s").alias("last_source"))
    w = Window.partitionBy("m", "field_name")
    # two values of one source alone are no conflict of sources
    seen = values.withColumns({"__n": F.count("*").over(w), "__lo": F.min("first_source").over(w), "__hi": F.max("last_source").over(w)}).filter("__n > 1 and __lo < __hi")
    return seen.select(F.col("m").alias(master), "field_name", F.col("v").alias("value"), "n_sources", "first_source")


def _by_master(records: DataFrame, master: str, source: str, fields: Sequence[str]) -> DataFrame:
    """``(m, s, f0, f1, ..)``: distinct rows of master, source and fields (as text), those of a master in one task."""
    rows = records.filter(F.col(master).isNotNull()).select(F.col(master).alias("m"), F.col(source).alias("s"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return rows.distinct().repartition("m")


def _fields(fields: Sequence[str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"f{i}").alias("v")) for i, f in enumerate(fields)])).alias("x")


def canonical_record(records: DataFrame, entity: str, priority: Column, tie: str) -> DataFrame:
    """One record per entity: the source of the highest priority, then the smallest id."""
    rest = [c for c in records.columns if c != entity]
    first = F.min_by(F.struct(*rest), F.struct(priority.alias("p"), F.col(tie).alias("t")))
    return records.groupBy(entity).agg(first.alias("__first")).select(entity, "__first.*").select(*records.columns)


def conflict_counts(records: DataFrame, master: str, source: str, fields: Sequence[str]) -> DataFrame:
    """``(field_name, source_a, source_b, masters, pairs)``: how often two sources disagree about a field.

    The distinct rows of a master are one array, as long as there are sources and values.  Its values by source give
    each pair of sources once, with the number of pairs of values, so only pairs of sources are counted after it.
    """
    rows = records.filter(F.col(master).isNotNull()).select(F.col(master).alias("m"), F.struct(F.col(source).alias("s"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]).alias("x"))
    known = rows.groupBy("m").agg(F.collect_set("x").alias("held")).filter(F.size("held") > 1)
    sources = F.array_distinct(F.transform("held", lambda x: x["s"]))
    values = lambda s, i: F.array_compact(F.array_distinct(F.transform(F.filter("held", lambda x: x["s"] == s), lambda x: x[f"f{i}"])))
    differ = lambda a, b: F.size(a["vs"]) * F.size(b["vs"]) - F.size(F.array_intersect(a["vs"], b["vs"]))
    met = lambda a, b: F.struct(a["s"].alias("source_a"), b["s"].alias("source_b"), differ(a, b).alias("n"))
    of = lambda by: F.flatten(F.transform(by, lambda a: F.transform(F.filter(by, lambda b: b["s"] > a["s"]), lambda b: met(a, b))))

    def conflicts(i: int, f: str) -> Column:
        by_source = F.transform(sources, lambda s: F.struct(s.alias("s"), values(s, i).alias("vs")))
        found = let(by_source, lambda by: F.filter(of(by), lambda p: p["n"] > 0))
        return F.transform(found, lambda p: F.struct(F.lit(f).alias("field_name"), p.alias("p")))

    parts = [conflicts(i, f) for i, f in enumerate(fields)]
    each = known.select(F.explode(F.concat(*parts)).alias("x")).select("x.field_name", "x.p.*")
    return each.groupBy("field_name", "source_a", "source_b").agg(F.count("*").alias("masters"), F.sum("n").alias("pairs"))


def source_priority(source: Column, order: Sequence[str]) -> Column:
    out = F.lit(len(order))
    for i, name in enumerate(order):
        out = F.when(source == name, i).otherwise(out)
    return out


def mirror_groups(records: DataFrame, master: str, source: str, record: str, most: int = LISTED) -> DataFrame:
    """Masters that several sources hold, with the first ``most`` sources, and how many sources and records there are."""
    counts = records.groupBy(master).agg(F.count_distinct(source).alias("n_sources"), F.count_distinct(record).alias("n_records")).filter("n_sources > 1")
    names = first_members(records.filter(F.col(source).isNotNull()).select(master, F.col(source).cast("string").alias("name")).distinct(), [master], F.col("name"), most)
    return counts.join(names, master).select(master, F.array_join("members", ",").alias("sources"), "n_sources", "n_records")


def briefing(sections: dict[str, DataFrame]) -> list[str]:
    """A line per section that has rows; sections are small aggregates."""
    return [f"{name}: {n}" for name, df in sections.items() if (n := df.count())]
