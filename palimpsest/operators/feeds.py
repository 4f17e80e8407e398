"""Feeds, pages and summaries over change events: what a reader of the library looks at."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .severity import severity_rank

#: Severities in order, and the separator of joined names.
SEVERITIES = ("critical", "important", "normal", "minor")
SEPARATOR = "\u001f"


def names_by(links: DataFrame, key: str, name: str) -> DataFrame:
    """``(key, names)``: distinct names in order, joined."""
    return links.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(name)), SEPARATOR).alias("names"))


def with_context(events: DataFrame, entity: str, watched: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Adds ``watched`` and ``monitors`` (joined names); an event stays one row however many monitors match."""
    w = watched.select(entity).distinct().withColumn("__w", F.lit(True))
    n = names_by(links, entity, name)
    joined = events.join(w, entity, "left").join(n, entity, "left")
    return joined.withColumns({"watched": F.coalesce("__w", F.lit(False)), "monitors": F.coalesce("names", F.lit(""))}).drop("__w", "names")


def feed_report(events: DataFrame, entity: str, ts: str, registry: str, category: Column) -> DataFrame:
    """``(section, name, part, n, entities)``: total, registries, severities, categories and days, in one pass.

    A grouping set per section; ``entities`` are the distinct ones of the section's row.
    """
    rows = events.select(F.col(entity).alias("entity"), F.col(registry).alias("registry"), F.coalesce("severity", F.lit("normal")).alias("severity"), category.alias("category"), F.date_format(ts, "yyyy-MM-dd").alias("day"))
    sets = [["registry"], ["severity"], ["category"], ["day", "severity"], []]
    found = rows.groupingSets(sets, "registry", "severity", "category", "day").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_distinct("entity").alias("entities"))
    bit = {"registry": 8, "severity": 4, "category": 2, "day": 1}  # a set bit: not grouped by
    of = lambda *cols: F.col("g") == 15 - sum(bit[c] for c in cols)
    section = F.when(of("registry"), "registry").when(of("severity"), "severity").when(of("category"), "category").when(of("day", "severity"), "trend").otherwise("total")
    name = F.when(section == "trend", F.col("day")).otherwise(F.coalesce("registry", "severity", "category", F.lit("")))
    return found.select(section.alias("section"), name.alias("name"), F.when(section == "trend", F.col("severity")).alias("part"), "n", "entities")


def update_feed(events: DataFrame, entity: str, ts: str, registry: str, category: Column, order: Sequence[Column], offset: int = 0, limit: int = 25) -> dict[str, DataFrame]:
    """``report`` and ``page`` of scoped events, which are stored once and read by both."""
    scoped = materialize(events, "scoped")
    return {"report": feed_report(scoped, entity, ts, registry, category), "page": scoped.orderBy(*order).offset(offset).limit(limit)}


def history(events: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """Every event of an entity, of all its versions and mirrors, numbered from the oldest."""
    return events.withColumn("position", F.row_number().over(Window.partitionBy(entity).orderBy(*order)))


def change_page(events: DataFrame, entity: str, order: Sequence[Column], group: Column | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Per entity the newest changes of a field group: adds ``total`` (of the filtered list) and ``nth``."""
    kept = events if group is None else events.filter(group)
    total = kept.groupBy(entity).agg(F.count("*").alias("total"))
    numbered = kept.withColumn("nth", F.row_number().over(Window.partitionBy(entity).orderBy(*order)))
    return numbered.filter((F.col("nth") > offset) & (F.col("nth") <= offset + limit)).join(total, entity)


def version_list(versions: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Adds ``change_count`` and ``top_rank`` to versions; a version without changes has rank 1, as any unknown severity."""
    per = events.groupBy(key).agg(F.count("*").alias("change_count"), F.max(F.greatest(severity_rank(F.col("severity")), F.lit(1))).alias("top_rank"))
    return versions.join(per, key, "left").withColumns({"change_count": F.coalesce("change_count", F.lit(0)), "top_rank": F.coalesce("top_rank", F.lit(1))})


def severity_counts(prefix: str = "") -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(prefix + s) for s in SEVERITIES[:2]]


def dashboard(events: DataFrame, records: DataFrame, entity: str, ts: str, first_seen: str, watched: DataFrame, since: str) -> DataFrame:
    """One row: new and updated entities, important changes and those of watched entities, since a time."""
    cut = F.lit(since).cast("timestamp_ntz")
    fresh = records.filter(F.col(first_seen) >= cut).agg(F.count_distinct(entity).alias("new_entities"))
    marked = events.filter(F.col(ts) >= cut).join(watched.select(entity).distinct().withColumn("__w", F.lit(True)), entity, "left")
    changed = marked.agg(F.count_distinct(entity).alias("updated_entities"), F.count_if(F.col("severity").isin("critical", "important")).alias("important_changes"), F.count_if(F.col("__w").isNotNull()).alias("watched_updates"))
    one = F.lit(1).alias("__one")
    return fresh.select("*", one).join(changed.select("*", one), "__one").drop("__one")


def watched_activity(watched: DataFrame, records: DataFrame, events: DataFrame, entity: str, source: str, ts: str, since: str) -> DataFrame:
    """Per watched entity: changes since a time, the last one, the highest severity rank, and its sources."""
    w = watched.select(entity).distinct()
    recent = events.filter(F.col(ts) >= F.lit(since).cast("timestamp_ntz")).join(w, entity, "left_semi")
    per = recent.groupBy(entity).agg(F.count("*").alias("change_count"), F.max(ts).alias("last_changed"), F.max(severity_rank(F.coalesce("severity", F.lit("normal")))).alias("top_rank"))
    sources = records.join(w, entity, "left_semi").groupBy(entity).agg(F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"))
    return sources.join(per, entity, "left").withColumns({"change_count": F.coalesce("change_count", F.lit(0)), "top_rank": F.coalesce("top_rank", F.lit(0))})


def project_cards(projects: DataFrame, members: Mapping[str, DataFrame], routes: Sequence[DataFrame], events: DataFrame, project: str, entity: str, ts: str, since: str) -> DataFrame:
    """Per project: how many members of each kind, recent critical and important changes, last activity.

    ``members`` are tables with the project's column, ``routes`` pairs of project and entity; an event
    that several routes reach counts once.
    """
    out = projects.select(project)
    for name, table in members.items():
        out = out.join(table.groupBy(project).agg(F.count("*").alias(name)), project, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    reached = routes[0].select(project, entity)
    for route in routes[1:]:
        reached = reached.unionByName(route.select(project, entity))
    recent = F.col(ts) >= F.lit(since).cast("timestamp_ntz")
    per = events.groupBy(entity).agg(*[F.count_if(recent & (F.col("severity") == s)).alias(s) for s in SEVERITIES[:2]], F.max(ts).alias("last_activity"))
    summed = reached.distinct().join(per, entity).groupBy(project).agg(*[F.sum(s).alias(f"recent_{s}") for s in SEVERITIES[:2]], F.max("last_activity").alias("last_activity"))
    zero = {f"recent_{s}": F.coalesce(f"recent_{s}", F.lit(0)) for s in SEVERITIES[:2]}
    return out.join(summed, project, "left").withColumns(zero)


def monitor_comparison(monitors: DataFrame, members: DataFrame, changes: DataFrame, events: DataFrame, monitor: str, entity: str) -> DataFrame:
    """Per monitor: current members, what entered, left and came again, changed members and their severities.

    ``members`` (monitor, entity, current), ``changes`` (monitor, change), ``events`` (entity, severity).
    """
    now = members.groupBy(monitor).agg(F.count_distinct(F.when(F.col("current"), F.col(entity))).alias("current_members"))
    moved = changes.groupBy(monitor).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("entered", "left", "reentered")])
    per = events.groupBy(entity).agg(*severity_counts())
    touched = members.select(monitor, entity).distinct().join(per, entity).groupBy(monitor).agg(F.count("*").alias("changed_members"), *[F.sum(s).alias(s) for s in SEVERITIES[:2]])
    out = monitors.select(monitor).join(now, monitor, "left").join(moved, monitor, "left").join(touched, monitor, "left")
    return out.na.fill(0)


def notification_feed(notes: DataFrame, monitors: DataFrame, canonical: DataFrame, channel: str = "email") -> DataFrame:
    """In-app notifications with the monitor's name (or the one kept with the note), the canonical source, and the sibling's status.

    ``notes`` (note_id, event_id, monitor_id, entity, channel, status, name_kept), ``monitors`` (monitor_id, name),
    ``canonical`` (entity, source); of several siblings the first by id counts.
    """
    sibling = notes.filter(F.col("channel") == channel).groupBy("event_id").agg(F.min_by("status", "note_id").alias("sibling_status"))
    shown = notes.filter("channel = 'in_app'").join(monitors, "monitor_id", "left").join(canonical, "entity", "left").join(sibling, "event_id", "left")
    return shown.select("note_id", "event_id", "entity", F.coalesce("name", "name_kept").alias("monitor_name"), "source", "sibling_status")


def queue_batch(queue: DataFrame, key: str, low: float | None = None, high: float | None = None, limit: int | None = None, status: str = "pending") -> DataFrame:
    """Items of a closed range of confidence, the surest first; ties by key."""
    c = F.col("confidence")
    kept = queue.filter((F.col("status") == status) & (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c <= high))
    ordered = kept.orderBy(F.desc("confidence"), key)
    return ordered if limit is None else ordered.limit(limit)


def saved_order(searches: DataFrame, by: str = "recent") -> list[Column]:
    """Order of saved searches: pinned first, then by recency or by name whatever its case."""
    rest = [F.desc("updated_at")] if by == "recent" else [F.lower("name")]
    return [F.desc("pinned"), *rest, F.asc("id")]


def sync_state(records: DataFrame, source: str, crawled: str, latest: Column, as_of: str, stale_days: int = 14) -> DataFrame:
    """Per source: latest records, last crawl, and whether it is older than ``stale_days``."""
    per = records.groupBy(source).agg(F.count_if(latest).alias("n_latest"), F.max(crawled).alias("last_crawl"))
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("last_crawl").cast("timestamp"))
    return per.withColumn("is_stale", F.coalesce(age > stale_days * 86400, F.lit(True)))


def case_hits(records: DataFrame, source: str, columns: Sequence[str], keywords: Sequence[str]) -> DataFrame:
    """Per source: records of which any column contains any keyword."""
    hit = F.lit(False)
    for c in columns:
        for k in keywords:
            hit = hit | F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(k.lower())
    return records.filter(hit).groupBy(source).agg(F.count("*").alias("n_hits"))


def digest_news(records: DataFrame, first_seen: str, since: str | None, as_of: str, bootstrap: Column, version: Column, latest: Column, order: Sequence[Column], hours: int = 24, limit: int = 200) -> DataFrame:
    """Records new since the last digest: first version, latest, not of the initial load; the newest ``limit``.

    Without a last digest the ``hours`` before ``as_of`` count.
    """
    cut = F.lit(since).cast("timestamp_ntz") if since else F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
    return records.filter((F.col(first_seen) > cut) & ~bootstrap & (version == 1) & latest).orderBy(*order).limit(limit)


def overview_counts(events: DataFrame, members: DataFrame, current: DataFrame, entity: str) -> DataFrame:
    """One row of all counts of the overview, each input read once.

    ``events`` (entity, field_name, severity) and ``members`` (change) of the scope and window, ``current``
    (entity, is_new) its records, several of which may share an entity.
    """
    field = lambda *names: F.col("field_name").isin(*names)
    outcome = field("primary_endpoint", "secondary_endpoints")
    e = events.agg(
        F.count("*").alias("change_events"),
        F.count_distinct(entity).alias("changed_entities"),
        *severity_counts(),
        F.count_if(field("status_id")).alias("status_transitions"),
        F.count_if(outcome).alias("outcome_changes"),
        F.count_distinct(F.when(outcome, F.col(entity))).alias("outcome_changed_entities"),
        F.count_if(field("enrollment")).alias("enrollment_changes"),
        F.count_if(field("start_date", "primary_completion_date", "completion_date")).alias("timeline_changes"),
        F.count_if(field("countries")).alias("country_changes"),
    )
    m = members.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("entered", "left", "reentered")])
    c = current.agg(F.count_distinct(entity).alias("current_entities"), F.count_distinct(F.when(F.col("is_new"), F.col(entity))).alias("new_entities"))
    one = F.lit(1).alias("__one")
    return e.select("*", one).join(m.select("*", one), "__one").join(c.select("*", one), "__one").drop("__one")


def overview(events: DataFrame, members: DataFrame, current: DataFrame, entity: str, ts: str, source: str, category: Column, k: int = 20) -> dict[str, DataFrame]:
    """All parts of the overview over one stored table of scoped events.

    ``counts``, ``report`` (registries, severities, categories, days), ``transitions`` with their first items,
    ``busiest`` entities, ``deltas`` of numbers, ``priority`` events and ``phases`` of current entities.
    """
    scoped = materialize(events, "scoped")
    status = scoped.filter("field_name = 'status_id'")
    first = F.slice(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col(ts).cast("timestamp"))).alias("at"), F.col("event_id")))), 1, k)
    top = status.withColumn("nth", F.row_number().over(Window.partitionBy("old_value", "new_value").orderBy(F.desc(ts), "event_id"))).filter(F.col("nth") <= k)
    pairs = status.groupBy("old_value", "new_value").agg(F.count("*").alias("n"))
    items = top.groupBy("old_value", "new_value").agg(F.transform(first, lambda x: x["event_id"]).alias("items"))
    a, b = F.col("old_value").try_cast("long"), F.col("new_value").try_cast("long")
    moved = scoped.filter("field_name = 'enrollment'").withColumns({"delta": b - a, "percent": F.when(a > 0, F.round((b - a) * 100 / a, 1))}).filter("delta is not null")
    return {
        "counts": overview_counts(scoped, members, current, entity),
        "report": feed_report(scoped, entity, ts, source, category),
        "transitions": pairs.join(items, ["old_value", "new_value"]),
        "busiest": scoped.groupBy(entity).agg(F.count("*").alias("n_events"), F.max(severity_rank(F.col("severity"))).alias("top_rank"), F.max(ts).alias("last_event")).orderBy(F.desc("n_events"), entity).limit(10),
        "deltas": moved.orderBy(F.desc(F.abs("delta")), "event_id").limit(k),
        "priority": scoped.filter(F.col("severity").isin("critical", "important")).orderBy(F.desc(ts), "event_id").limit(k),
        "phases": current.groupBy(entity).agg(F.min_by("phase", "rank").alias("phase")).groupBy(F.coalesce("phase", F.lit("Unknown")).alias("phase")).agg(F.count("*").alias("n")),
    }
