"""Saved rules: membership diffs, schedules, outbox, baselines and digests."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .severity import severity_rank


def membership_diff(previous: DataFrame, current: DataFrame, key: str, ever: DataFrame | None = None) -> DataFrame:
    """``(key, change)``: entered, reentered (known from ``ever``), left or stayed."""
    a = previous.select(key).distinct().withColumn("__was", F.lit(True))
    b = current.select(key).distinct().withColumn("__is", F.lit(True))
    both = a.join(b, key, "full_outer")
    again = F.lit(False)
    if ever is not None:
        both = both.join(ever.select(key).distinct().withColumn("__ever", F.lit(True)), key, "left")
        again = F.col("__ever").isNotNull()
    change = F.when(F.col("__was").isNotNull() & F.col("__is").isNotNull(), "stayed").when(F.col("__was").isNotNull(), "left").when(again, "reentered").otherwise("entered")
    return both.select(key, change.alias("change"))


def run_monitor(previous: DataFrame | None, current: DataFrame, key: str, events: DataFrame, event_time: str, last_completed: str | None, ever: DataFrame | None = None) -> DataFrame:
    """Events of one run: membership changes, then changed members since the last completed run.

    The first run takes the baseline and reports nothing.
    """
    if previous is None:
        return current.select(key).limit(0).select(key, F.lit("").alias("change"))
    moved = membership_diff(previous, current, key, ever).filter("change <> 'stayed'")
    if last_completed is None:
        return moved
    touched = events.filter(F.col(event_time) > F.lit(last_completed).cast("timestamp_ntz")).join(current.select(key), key, "left_semi").select(key).distinct()
    return moved.unionByName(touched.withColumn("change", F.lit("trial_changed")))


def next_due(anchor: datetime, interval: timedelta, now: datetime) -> datetime:
    """The first slot of the schedule after now; missed slots are skipped."""
    if now < anchor:
        return anchor
    return anchor + (int((now - anchor) / interval) + 1) * interval


def next_due_column(anchor: Column, interval_seconds: Column, now: Column) -> Column:
    """``next_due`` on unix seconds."""
    return F.when(now < anchor, anchor).otherwise(anchor + (F.floor((now - anchor) / interval_seconds) + 1) * interval_seconds)


def reconcile_outbox(events: DataFrame, channels: Sequence[str], existing: DataFrame, key: Sequence[str], activated: Column) -> DataFrame:
    """Notifications still to be written: one per event and enabled channel, none twice, none before activation."""
    wanted = events.filter(activated).withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    return wanted.dropDuplicates([*key, "channel"]).join(existing.select(*key, "channel"), [*key, "channel"], "left_anti")


def stale_claims(claims: DataFrame, started: str, as_of: str, minutes: int = 120) -> DataFrame:
    """Claims running longer than allowed become interrupted."""
    cut = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {minutes} minutes")
    return claims.withColumn("status", F.when((F.col("status") == "running") & (F.col(started) < cut), "interrupted").otherwise(F.col("status")))


def signature(columns: Sequence[str]) -> Column:
    return F.substring(F.sha2(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 32)


def baseline_diff(baseline: DataFrame, current: DataFrame, key: str, sign: str) -> DataFrame:
    """``(key, change)`` of new, changed and unchanged rows against a baseline of signatures."""
    old = baseline.select(key, F.col(sign).alias("__old"))
    change = F.when(F.col("__old").isNull(), "new").when(F.col("__old") != F.col(sign), "changed").otherwise("unchanged")
    return current.select(key, sign).join(old, key, "left").select(key, change.alias("change"))


def report_rows(current: DataFrame, baseline: DataFrame | None, key: str, sign: str, mode: str, since: str | None = None, crawled: str = "last_crawled_at") -> DataFrame:
    """Rows of a report: ``force`` all, ``since`` a time, ``incremental`` against the baseline."""
    if mode == "force" or (mode == "incremental" and baseline is None):
        return current
    if mode == "since":
        return current.filter(F.col(crawled) >= F.lit(since).cast("timestamp_ntz"))
    if mode == "incremental":
        return current.join(baseline_diff(baseline, current, key, sign).filter("change <> 'unchanged'").select(key), key, "left_semi")
    raise ValueError(f"unknown report mode {mode!r}")


def digest(events: DataFrame, event_id: str, after: int, profiles: Sequence[tuple[str, Column]]) -> DataFrame:
    """Events beyond the watermark with the first profile they match; none is cut off."""
    which = F.lit(None).cast("string")
    for name, predicate in reversed(list(profiles)):
        which = F.when(predicate, name).otherwise(which)
    return events.filter(F.col(event_id) > after).withColumn("profile", which).filter("profile is not null")


def advanced_watermark(sent: DataFrame, event_id: str, before: int, succeeded: bool) -> int:
    """The new watermark; it stays where no channel succeeded."""
    top = sent.agg(F.max(event_id)).first()[0] if succeeded else None
    return before if top is None else max(before, top)


def preferred_events(events: DataFrame, watches: DataFrame, preferences: DataFrame, entity: str, group: Column, severity: Column) -> DataFrame:
    """``(watch_id, events...)``: events of watched entities that the watch's preferences let through.

    ``watches``: ``(watch_id, entity)``; ``preferences``: ``(watch_id, field_group, enabled, minimum_severity)``,
    one row per watch and group.  A group without a preference is let through from ``normal`` on; a
    disabled one is not.
    """
    graded = events.withColumns({"pref_group": group, "pref_rank": severity_rank(severity)})
    watched = graded.join(watches.select("watch_id", entity), entity)
    chosen = preferences.select("watch_id", F.col("field_group").alias("pref_group"), F.coalesce("enabled", F.lit(True)).alias("pref_on"), severity_rank(F.coalesce("minimum_severity", F.lit("normal"))).alias("pref_least"))
    joined = watched.join(chosen, ["watch_id", "pref_group"], "left")
    passed = F.coalesce("pref_on", F.lit(True)) & (F.col("pref_rank") >= F.coalesce("pref_least", severity_rank(F.lit("normal"))))
    return joined.filter(passed).select("watch_id", *events.columns)


def report_key(keywords: Sequence[str]) -> str:
    """The name under which a keyword set keeps its baseline; order, case and repetition don't matter."""
    return "|".join(sorted({k.strip().lower() for k in keywords if k.strip()}))


def baseline_report(current: DataFrame, key: str, sign: str, crawled: str, baseline: DataFrame | None = None, generated: str | None = None, force: bool = False, since: str | None = None) -> DataFrame:
    """The rows of a report with ``change`` (new, changed, unchanged, or null where nothing is compared).

    * ``force``: all rows; compared with the baseline unless ``since`` is given.
    * ``since``: rows crawled then or later.
    * a ``baseline`` of signatures: what is new or changed.
    * a last report that left no signatures (``generated`` alone): rows crawled since then.
    * no last report: all rows.
    """
    plain = lambda df: df.withColumn("change", F.lit(None).cast("string"))
    window = lambda start: plain(current.filter(F.col(crawled) >= F.lit(start).cast("timestamp_ntz")))
    if since is not None:
        return window(since)
    if baseline is not None:
        told = current.join(baseline_diff(baseline, current, key, sign), key)
        return told if force else told.filter("change <> 'unchanged'")
    return window(generated) if generated is not None and not force else plain(current)
