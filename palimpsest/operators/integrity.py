"""Integrity checks of the stored tables: orphans, repeated keys, impossible states, stale claims."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import audit


@dataclass(frozen=True)
class Orphans:
    """Rows of ``child`` whose keys are not in ``parent``; null keys count only where ``nulls`` says so."""

    child: str
    parent: str
    on: tuple[tuple[str, str], ...]
    nulls: bool = True

    def bad(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        c, p = tables[self.child], tables[self.parent]
        keys = p.select(*[F.col(b).alias(f"__p{i}") for i, (_, b) in enumerate(self.on)]).distinct()
        same = reduce(lambda x, y: x & y, [F.col(a) == F.col(f"__p{i}") for i, (a, _) in enumerate(self.on)])
        rows = c if self.nulls else c.filter(F.col(self.on[0][0]).isNotNull())
        return rows.join(keys, same, "left_anti")


@dataclass(frozen=True)
class Repeated:
    """Keys of several rows; ``where`` limits the rows."""

    table: str
    keys: tuple[str, ...]
    where: str = "true"

    def bad(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        return tables[self.table].filter(self.where).groupBy(*[F.expr(k) for k in self.keys]).agg(F.count("*").alias("__n")).filter("__n > 1")


@dataclass(frozen=True)
class Broken:
    """Rows that a rule calls bad; a rule that is null calls nothing bad."""

    table: str
    rule: Callable[[], Column]

    def bad(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        return tables[self.table].filter(self.rule())


#: States of runs that have ended, and what a notification may be.
ENDED = ("succeeded", "failed", "interrupted", "partially_succeeded")
CHANNELS, STATES = ("in_app", "email"), ("pending", "sending", "delivered", "failed")


def _impossible_run() -> Column:
    """A run has an end exactly if it is over, and a failed one moves no cursor."""
    status, over = F.col("status"), F.col("finished_at").isNotNull()
    moved = (status == "failed") & F.col("cursor_after").isNotNull()
    return F.when(status == "running", over).when(status.isin(*ENDED), ~over | moved)


def _unknown_notification() -> Column:
    return ~(F.col("channel").isin(*CHANNELS) & F.col("status").isin(*STATES))


def _read_mail() -> Column:
    """Only what is shown in the application can be marked as read."""
    return F.col("read_at").isNotNull() & (F.col("channel") == "email")


@dataclass(frozen=True)
class NotLast:
    """Rows marked latest whose version is not the highest of their key."""

    table: str
    keys: tuple[str, ...]

    def bad(self, tables: Mapping[str, DataFrame]) -> DataFrame:
        per = tables[self.table].groupBy(*self.keys).agg(F.max("version_number").alias("top"), F.collect_set(F.when(F.col("is_latest"), F.col("version_number"))).alias("latest"))
        return per.select(F.explode("latest").alias("v"), "top").filter("v <> top")


#: Severity and code of each check.
CHECKS = (
    ("critical", "NOTIFICATION_EVENT_MISSING", Orphans("notifications", "monitor_events", (("monitor_event_id", "id"),))),
    ("error", "MONITOR_EVENT_MONITOR_MISSING", Orphans("monitor_events", "monitors", (("monitor_id", "id"),))),
    ("error", "MONITOR_EVENT_TRIAL_EVENT_MISSING", Orphans("monitor_events", "trial_events", (("related_change_event_id", "event_id"),), nulls=False)),
    ("error", "EVIDENCE_EVENT_MISSING", Orphans("project_evidence", "trial_events", (("event_id", "event_id"),))),
    ("error", "PROJECT_SEARCH_MISSING", Orphans("project_saved_searches", "saved_searches", (("saved_search_id", "id"),))),
    ("error", "PROJECT_MONITOR_MISSING", Orphans("project_monitors", "monitors", (("monitor_id", "id"),))),
    ("error", "PROJECT_TRIAL_MISSING", Orphans("project_trials", "registry_records", (("trial_id", "source_trial_id"), ("source", "source")))),
    ("error", "DUPLICATE_EVENT_HASH", Repeated("trial_events", ("event_hash",))),
    ("error", "DUPLICATE_LOGICAL_EVENT", Repeated("trial_events", ("record_id", "field_name", "coalesce(old_value, '')", "coalesce(new_value, '')", "detected_at"))),
    ("error", "DUPLICATE_REGISTRY_VERSION", Repeated("registry_records", ("source", "source_trial_id", "version_number"))),
    ("error", "INVALID_LATEST_VERSION", NotLast("registry_records", ("source", "source_trial_id"))),
    ("error", "DUPLICATE_MONITOR_OCCURRENCE", Repeated("monitor_runs", ("monitor_id", "scheduled_for"), "scheduled_for is not null")),
    ("error", "DUPLICATE_INGESTION_OCCURRENCE", Repeated("ingestion_runs", ("source", "scheduled_for"), "scheduled_for is not null")),
    ("error", "DUPLICATE_NOTIFICATION", Repeated("notifications", ("monitor_event_id", "channel"))),
    ("error", "MULTIPLE_RUNNING_INGESTIONS", Repeated("ingestion_runs", ("source",), "status = 'running'")),
    ("error", "IMPOSSIBLE_INGESTION_STATE", Broken("ingestion_runs", _impossible_run)),
    ("error", "INVALID_NOTIFICATION_STATE", Broken("notifications", _unknown_notification)),
    ("error", "INVALID_NOTIFICATION_READ_STATE", Broken("notifications", _read_mail)),
)
#: Claims that may grow stale: code, table, column of the start, and which rows are claimed.
CLAIMS = (
    ("STALE_INGESTION", "ingestion_runs", "started_at", "status = 'running'"),
    ("STALE_MONITOR_RUN", "monitor_runs", "started_at", "status = 'running'"),
    ("STALE_EMAIL_CLAIM", "notifications", "claimed_at", "status = 'sending' and channel = 'email'"),
)


def integrity(tables: Mapping[str, DataFrame], as_of: str, stale_minutes: int = 120, only: Sequence[str] | None = None) -> DataFrame:
    """``(severity, code, n)`` of all checks whose tables are given (or of ``only`` these codes)."""
    parts = []
    for severity, code, check in CHECKS:
        needed = [getattr(check, k) for k in ("table", "child", "parent") if hasattr(check, k)]
        if all(t in tables for t in needed) and (only is None or code in only):
            parts.append(check.bad(tables).agg(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.count("*").alias("n")))
    cut = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {stale_minutes} minutes")
    for code, name, started, claimed in CLAIMS:
        if name in tables and (only is None or code in only):
            parts.append(tables[name].filter(F.expr(claimed) & (F.col(started) < cut)).agg(F.lit("warning").alias("severity"), F.lit(code).alias("code"), F.count("*").alias("n")))
    return audit(parts)
