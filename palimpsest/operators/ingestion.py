"""Durable runs of ingestion: one claim per occurrence, cursors that move on success alone.

Everything is a small file in a folder that the whole cluster shares.  A claim is a file that is
created only if it is not there, which the file system decides: of several claimants one wins.  A run's
outcome is a second file, written once.  A failed run leaves the cursor where it was, so the next run
starts from the last success; its claim stays, and a retry is an occurrence of its own.

An empty answer of a source that has records already is a failure, never news that all are gone,
unless the caller allows it.  Runs that are claimed longer than ``stale_after`` without an outcome count
as interrupted: they block nothing.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "source string, occurrence string, status string, started string, finished string, cursor_before string, cursor_after string, n_found long, error string"


@dataclass
class Run:
    source: str
    occurrence: str
    status: str  # running, succeeded, failed, interrupted, already_claimed, busy
    started: str
    finished: str | None = None
    cursor_before: str | None = None
    cursor_after: str | None = None
    n_found: int | None = None
    error: str | None = None


@dataclass
class Found:
    """What a collector brought: rows that are stored already, and how far they reach."""

    n: int
    cursor: str | None


class Ledger:
    """Claims and outcomes of the runs in one folder."""

    def __init__(self, spark: SparkSession, path: str, stale_after: timedelta = timedelta(hours=2)):
        self.spark, self.path, self.stale_after = spark, path.rstrip("/"), stale_after

    def _place(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *(quote(p, safe="") for p in parts)]))

    def _files(self, place):
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _create(self, text: str, *parts: str) -> bool:
        """Create a file with this text; False if it exists.  The claim is the create, not the text.

        Hadoop's local file system looks before it creates, so two may both create; there the
        operating system's exclusive create decides.
        """
        place = self._place(*parts)
        files = self._files(place)
        files.mkdirs(place.getParent())
        local = files.makeQualified(place).toUri()
        if local.getScheme() == "file":
            try:
                at = os.open(local.getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                return False
            with os.fdopen(at, "w") as out:
                out.write(text)
            return True
        try:
            out = files.create(place, False)
        except Py4JJavaError as problem:
            if files.exists(place):
                return False
            raise problem
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _names(self, *parts: str) -> list[str]:
        place = self._place(*parts)
        files = self._files(place)
        return sorted(s.getPath().getName() for s in files.listStatus(place)) if files.exists(place) else []

    def claim(self, source: str, occurrence: str, now: datetime) -> Run:
        """Claim an occurrence (a scheduled time, say).

        ``status`` of the answer: ``running`` if it is ours, ``already_claimed`` if it was taken before,
        ``busy`` if another occurrence of the source is running.
        """
        if any(r.status == "running" for r in self.runs(source, now) if r.occurrence != occurrence):
            return Run(source, occurrence, "busy", now.isoformat())
        run = Run(source, occurrence, "running", now.isoformat(), cursor_before=self.cursor(source))
        if not self._create(json.dumps(asdict(run)), source, occurrence + ".claim"):
            return Run(source, occurrence, "already_claimed", now.isoformat())
        return run

    def finish(self, run: Run, now: datetime, found: Found | None = None, error: str | None = None) -> Run:
        """Write the outcome, once; a later one is ignored."""
        good = error is None and found is not None
        run.status, run.finished, run.error = "succeeded" if good else "failed", now.isoformat(), error and error[:1000]
        run.n_found = found.n if found else None
        run.cursor_after = (found.cursor if found.cursor is not None else run.cursor_before) if good else None
        self._create(json.dumps(asdict(run)), run.source, run.occurrence + ".outcome")
        return run

    def runs(self, source: str, now: datetime) -> list[Run]:
        """The runs of a source in the order of their start."""
        out = []
        names = set(self._names(source))
        for name in names:
            if not name.endswith(".claim"):
                continue
            stem = name.removesuffix(".claim")
            done = self._read_named(source, stem + ".outcome") if stem + ".outcome" in names else None
            told = done or self._read_named(source, name)
            if not told:  # claimed this moment
                continue
            run = Run(**told)
            if run.status == "running" and datetime.fromisoformat(run.started) < now - self.stale_after:
                run.status = "interrupted"
            out.append(run)
        return sorted(out, key=lambda r: (r.started, r.occurrence))

    def _read_named(self, source: str, name: str) -> dict | None:
        """What a file of a source says; None while it is being written."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._place(source), name)
        stream = self._files(place).open(place)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text) if text else None

    def cursor(self, source: str) -> str | None:
        """Where the last success ended."""
        done = [self._read_named(source, n) for n in self._names(source) if n.endswith(".outcome")]
        good = [d for d in done if d and d["status"] == "succeeded" and d["cursor_after"] is not None]
        return max(good, key=lambda d: (d["started"], d["occurrence"]))["cursor_after"] if good else None

    def table(self, source: str, now: datetime) -> DataFrame:
        """The runs of a source as a table."""
        return self.spark.createDataFrame([tuple(asdict(r).values()) for r in self.runs(source, now)], RUN)


def run_once(ledger: Ledger, source: str, occurrence: str, collect: Callable[[str | None], Found], now: Callable[[], datetime], known: DataFrame | None = None, since: str | None = None, full: bool = False, allow_empty: bool = False) -> Run:
    """Claim, collect and finish one occurrence.

    ``collect`` gets the cursor to start from (``since`` if given, none for a ``full`` run) and stores
    what it finds.  ``known``: the records of the source before.
    """
    run = ledger.claim(source, occurrence, now())
    if run.status != "running":
        return run
    start = None if full else since if since is not None else run.cursor_before
    try:
        found = collect(start)
        if found.n == 0 and not allow_empty and known is not None and not known.isEmpty():
            raise ValueError("empty answer of a source with records")
    except Exception as problem:  # noqa: BLE001  whatever went wrong is the run's outcome
        return ledger.finish(run, now(), error=f"{type(problem).__name__}: {problem}")
    return ledger.finish(run, now(), found)


def failures_in_a_row(runs: DataFrame) -> DataFrame:
    """``(source, failures)``: failed runs since the last success."""
    last = runs.groupBy("source").agg(F.max(F.when(F.col("status") == "succeeded", F.struct("started", "occurrence"))).alias("good"))
    after = F.col("good").isNull() | (F.struct("started", "occurrence") > F.col("good"))
    return runs.join(last, "source").groupBy("source").agg(F.count_if(after & (F.col("status") == "failed")).alias("failures"))
