"""One periodic run over a landed feed: ingest, changes, resolution, quality, report, digest, backup.

The run is claimed in the ledger, reads what was updated since the cursor, and takes it into the change
log as one numbered batch; only then does the cursor move.  What follows is computed from the stored
versions, so a run that failed halfway is made good by the next one.  An occurrence that was claimed
before does nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks
from ..storage import exists
from . import arrival, ingestion, late, monitors, quality, resolve, versions


@dataclass
class Feed:
    """What a periodic run needs to know of a feed."""

    source: str
    key: str  # id of a record within the feed
    updated: str  # text column whose values order the versions and are the cursor
    version: str  # number of a stored row, which breaks ties
    fields: Sequence[str]
    payload: str  # where identifiers are looked for
    matches: Column  # rows of the report's keywords
    keywords: Sequence[str]


def _signed(rows: DataFrame, feed: Feed) -> DataFrame:
    return rows.withColumn("signature", monitors.signature(list(feed.fields)))


def _log(spark: SparkSession, folder: str, feed: Feed) -> late.ChangeLog:
    return late.ChangeLog(spark, f"{folder}/log", [feed.key], [feed.updated, feed.version], list(feed.fields), [feed.payload])


def ingest(spark: SparkSession, folder: str, feed: Feed, landed: DataFrame, occurrence: str, now: Callable[[], datetime]) -> ingestion.Run:
    """Claim the occurrence and take the landed rows since the cursor into the change log."""
    log = _log(spark, folder, feed)
    ledger = ingestion.Ledger(spark, f"{folder}/runs")

    def collect(start: str | None) -> ingestion.Found:
        # the cursor's own day is read again, as late rows arrive on it
        rows = landed if start is None else landed.filter(F.col(feed.updated) >= F.lit(start))
        told = rows.agg(F.count("*").alias("n"), F.max(feed.updated).alias("last")).first()
        log.add(rows, len(ledger.runs(feed.source, now())))  # this run's claim is the last of them
        return ingestion.Found(told["n"], told["last"])

    known = log.versions() if exists(spark, f"{folder}/log/versions") else None
    return ingestion.run_once(ledger, feed.source, occurrence, collect, now, known)


def periodic_run(spark: SparkSession, folder: str, feed: Feed, landed: DataFrame, occurrence: str, now: Callable[[], datetime], keep: int = 7) -> dict[str, object]:
    """``run`` and, if it succeeded, the tables ``events``, ``latest``, ``resolved``, ``missing``, ``report``, and the path of the ``snapshot``."""
    run = ingest(spark, folder, feed, landed, occurrence, now)
    out: dict[str, object] = {"run": run}
    if run.status != "succeeded":
        return out
    log = _log(spark, folder, feed)
    latest = _signed(versions.latest(log.versions(), [feed.key], [feed.updated, feed.version]), feed)
    identifiers = resolve.record_identifiers(latest, feed.version, feed.key, feed.payload)
    baseline_path = f"{folder}/baselines/{monitors.report_key(feed.keywords)}"
    baseline = sinks.restore(spark, baseline_path) if sinks.snapshots(spark, baseline_path) else None
    current = latest.filter(feed.matches)
    report = monitors.baseline_report(current, feed.key, "signature", feed.updated, baseline)
    # the report is written before the baseline moves on
    place = f"{folder}/exports/{occurrence}"
    sinks.csv_export(report.select(feed.key, "change", *feed.fields), place)
    out |= {
        "events": log.events(),
        "latest": latest,
        "resolved": arrival.resolve_in_order(latest, identifiers, feed.version, [feed.updated]),
        "missing": quality.missing_counts(latest, list(feed.fields)),
        "report": spark.read.csv(place, header=True, encoding="UTF-8").withColumnRenamed(sinks.BOM + feed.key, feed.key),
    }
    out["snapshot"] = sinks.snapshot(current.select(feed.key, "signature"), baseline_path, occurrence, keep)
    return out
