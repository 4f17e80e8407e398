"""Ordered folds per key, over a stream with timers and over a table: the same result.

A fold takes a key's events in the order of ``(time, id)`` and keeps a small typed state.  In a
stream, events wait in keyed state until the watermark has passed them, so events that arrive out of
order within the watermark are still taken in order; timers wake the fold when a wait is over or
when the state itself is due.  State of a key that was idle for ``idle`` is dropped.  On a table,
each partition is sorted by key and order and folded as a stream of rows.

``Breaker``: failures in a row open it, later events are refused until it resets.
``Attempts``: tries per key until one succeeds or the last try fails.
``Membership``: entered, left and reentered by a flag per event.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

#: Where the state of a stream is kept; transformWithState needs it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
EVENT = "at long, id long, what string"
OUTPUT = "at long, id long, what string, state string, n int"


class Fold:
    """Events are ``(at, id, what)``, outputs ``(at, id, what, state, n)``; times are milliseconds."""

    state_schema: str
    start: tuple

    def step(self, state: tuple, at: int, event: int, what: str) -> tuple[tuple, list[tuple]]:
        """State and outputs after an event."""
        raise NotImplementedError

    def due(self, state: tuple) -> int | None:
        """When the state changes by itself."""
        return None

    def wake(self, state: tuple) -> tuple[tuple, list[tuple]]:
        """State and outputs at the time ``due`` names."""
        return state, []

    def advance(self, state: tuple, now: int) -> tuple[tuple, list[tuple]]:
        """All wakes up to ``now``."""
        out: list[tuple] = []
        while (due := self.due(state)) is not None and due <= now:
            state, found = self.wake(state)
            out += found
        return state, out

    def take(self, state: tuple, at: int, event: int, what: str) -> tuple[tuple, list[tuple]]:
        """An event, after the wakes before it."""
        state, before = self.advance(state, at)
        state, found = self.step(state, at, event, what)
        return state, before + found


@dataclass
class Breaker(Fold):
    """``what``: success, failure or challenge.  A refused event changes nothing."""

    failures: int = 5
    challenges: int = 3
    reset_ms: int = 3_600_000  # 0: never
    state_schema = "failures int, challenges int, opened long, reason string"
    start = (0, 0, -1, "")

    def step(self, state, at, event, what):
        failed, challenged, opened, reason = state
        if opened >= 0:
            return state, [(at, event, what, "refused", 0)]
        failed = failed + 1 if what == "failure" else 0 if what == "success" else failed
        challenged = challenged + 1 if what == "challenge" else 0 if what == "success" else challenged
        for name, n, most in (("failure", failed, self.failures), ("challenge", challenged, self.challenges)):
            if what == name and 0 < most <= n:
                return (failed, challenged, at, name), [(at, event, what, "opened", n)]
        return (failed, challenged, -1, ""), [(at, event, what, "passed", max(failed, challenged))]

    def due(self, state):
        return state[2] + self.reset_ms if state[2] >= 0 and self.reset_ms > 0 else None

    def wake(self, state):
        return self.start, [(self.due(state), -1, state[3], "reset", 0)]


@dataclass
class Attempts(Fold):
    """``what``: done or failed.  After ``most`` failures a key is given up, once; a success starts anew."""

    most: int = 3
    state_schema = "tries int, over boolean"
    start = (0, False)

    def step(self, state, at, event, what):
        tries, over = state
        if over:
            return state, [(at, event, what, "ignored", tries)]
        if what == "done":
            return self.start, [(at, event, what, "done", tries + 1)]
        tries += 1
        return (tries, tries >= self.most), [(at, event, what, "given_up" if tries >= self.most else "retry", tries)]


@dataclass
class Membership(Fold):
    """``what``: in or out.  Outputs are changes only; ``n`` counts the entries."""

    state_schema = "inside boolean, entries int"
    start = (False, 0)

    def step(self, state, at, event, what):
        inside, entries = state
        if what == "in" and not inside:
            return (True, entries + 1), [(at, event, what, "reentered" if entries else "entered", entries + 1)]
        if what == "out" and inside:
            return (False, entries), [(at, event, what, "left", entries)]
        return state, []


def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(str(key[0]), *r) for r in rows], columns=["key", "at", "id", "what", "state", "n"])


class _Keeper(StatefulProcessor):
    """State of one key: the fold's state, the events that wait, and when the key was last seen."""

    def __init__(self, fold: Fold, idle_ms: int):
        self.fold, self.idle_ms = fold, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fold.state_schema)
        self.waiting = handle.getListState("waiting", EVENT)
        self.seen = handle.getValueState("seen", "at long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {tuple(x) for x in self.waiting.get()} if self.waiting.exists() else set()
        fresh = {(int(r.at), int(r.id), r.what) for frame in rows for r in frame.itertuples(index=False)} - known
        if fresh:
            self.waiting.put(sorted(known | fresh))
        for at in {x[0] for x in fresh}:
            self.handle.registerTimer(at)
        yield _frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        state = tuple(self.state.get()) if self.state.exists() else self.fold.start
        last = self.seen.get()[0] if self.seen.exists() else None
        ready, later = [x for x in held if x[0] <= now], [x for x in held if x[0] > now]
        out: list[tuple] = []
        for at, event, what in ready:
            state, found = self.fold.take(state, at, event, what)
            out, last = out + found, at
        state, found = self.fold.advance(state, now)
        out += found
        due = self.fold.due(state)
        if not later and due is None and last is not None and now >= last + self.idle_ms:
            for x in (self.state, self.waiting, self.seen):
                x.clear()
        else:
            self.state.update(state)
            if ready:
                self.seen.update((last,))
                self.handle.registerTimer(last + self.idle_ms)
                if later:
                    self.waiting.put(later)
                else:
                    self.waiting.clear()
            if due is not None:
                self.handle.registerTimer(due)
        yield _frame(key, out)


def _events(rows: DataFrame, key: str, time: str, event: str, what: str) -> DataFrame:
    when = F.col(time).cast("timestamp")
    return rows.select(F.col(key).cast("string").alias("key"), when.alias("time"), F.unix_millis(when).alias("at"), F.col(event).cast("long").alias("id"), F.col(what).cast("string").alias("what")).filter("key is not null and time is not null")


def fold_stream(rows: DataFrame, key: str, time: str, event: str, what: str, fold: Fold, late: str = "1 day", idle_ms: int = 30 * 86_400_000) -> DataFrame:
    """``(key, at, id, what, state, n)`` of a stream, as the watermark passes the events.

    Repeated events (same time, id and kind) count once while they wait.  The session needs
    ``STATE_STORE``.  Events later than ``late`` are dropped by the watermark.
    """
    rows.sparkSession.conf.set(*STATE_STORE)
    given = _events(rows, key, time, event, what).withWatermark("time", late)
    return given.groupBy("key").transformWithStateInPandas(_Keeper(fold, idle_ms), StructType.fromDDL("key string, " + OUTPUT), "Append", "EventTime")


def fold_table(rows: DataFrame, key: str, time: str, event: str, what: str, fold: Fold, until_ms: int | None = None) -> DataFrame:
    """The same of a table: every event, and the wakes up to ``until_ms`` (default: the key's last event)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, out = None, fold.start, []
        for frame in frames:
            for r in frame.itertuples(index=False):
                if r.key != held:
                    if held is not None and until_ms is not None:
                        out += [(held, *x) for x in fold.advance(state, until_ms)[1]]
                    held, state = r.key, fold.start
                state, found = fold.take(state, int(r.at), int(r.id), r.what)
                out += [(held, *x) for x in found]
            yield pd.DataFrame(out, columns=["key", "at", "id", "what", "state", "n"])
            out = []
        if held is not None and until_ms is not None:
            yield pd.DataFrame([(held, *x) for x in fold.advance(state, until_ms)[1]], columns=["key", "at", "id", "what", "state", "n"])

    given = _events(rows, key, time, event, what).select("key", "at", "id", "what").distinct()
    return given.repartition("key").sortWithinPartitions("key", "at", "id", "what").mapInPandas(run, "key string, " + OUTPUT)
