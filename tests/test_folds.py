"""Folds: breaker, attempts and membership; a stream equals the table, with restarts."""

import datetime as dt
import random

import pytest

from palimpsest.streaming import folds

SCHEMA = "src string, ts timestamp, eid long, what string"
START = dt.datetime(2024, 1, 1)


def events_of(seed, kinds, n=160):
    r = random.Random(seed)
    return [(r.choice(["a", "a", "b", "c"]), START + dt.timedelta(minutes=r.randrange(3000)), i, r.choice(kinds)) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.select("key", "at", "id", "what", "state", "n").collect()))


FOLDS = {
    "breaker": (folds.Breaker(failures=3, challenges=2, reset_ms=90 * 60_000), ["success", "failure", "failure", "challenge"]),
    "attempts": (folds.Attempts(most=3), ["failed", "failed", "failed", "done"]),
    "membership": (folds.Membership(), ["in", "out"]),
}


@pytest.mark.parametrize("name", list(FOLDS))
def test_stream_equals_table(spark, tmp_path, name):
    fold, kinds = FOLDS[name]
    rows_in = events_of(3, kinds)
    rows_in.sort(key=lambda x: x[1] + dt.timedelta(minutes=random.Random(x[2]).randrange(500)))  # out of order, within the watermark
    end = START + dt.timedelta(days=30)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    batches = [rows_in[:60], rows_in[60:120], rows_in[120:], [("flush", end, 9_000, "success")]]
    for part in batches:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        found = folds.fold_stream(stream, "src", "ts", "eid", "what", fold, late="1 day", idle_ms=400 * 86_400_000)
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
        assert query.exception() is None
    got = [x for x in rows(spark.read.parquet(out)) if x[0] != "flush"]
    table = spark.createDataFrame(rows_in, SCHEMA)
    until = int((end - dt.timedelta(days=2)).timestamp() * 1000)
    assert got == rows(folds.fold_table(table.unionByName(table.limit(5)), "src", "ts", "eid", "what", fold, until_ms=until)) and len(got) > 20


def test_breaker_opens_refuses_and_resets():
    fold = folds.Breaker(failures=2, challenges=2, reset_ms=100)
    state, out = fold.start, []
    for at, what in [(0, "failure"), (1, "challenge"), (2, "failure"), (3, "success"), (50, "failure"), (102, "success"), (103, "challenge"), (104, "failure"), (105, "challenge"), (106, "success")]:
        state, found = fold.take(state, at, at, what)
        out += [(x[0], x[3], x[4]) for x in found]
    assert out == [(0, "passed", 1), (1, "passed", 1), (2, "opened", 2), (3, "refused", 0), (50, "refused", 0), (102, "reset", 0), (102, "passed", 0), (103, "passed", 1), (104, "passed", 1), (105, "opened", 2), (106, "refused", 0)]
    never = folds.Breaker(failures=0, challenges=1, reset_ms=0)
    state, _ = never.take(never.start, 0, 0, "challenge")
    assert never.due(state) is None and never.take(state, 10**12, 1, "success")[1][0][3] == "refused"
    off = folds.Breaker(failures=0, challenges=0)
    state = off.start
    for k in range(20):
        state, found = off.take(state, k, k, "failure")
        assert found[0][3] == "passed"


def test_table_fold_of_odd_rows(spark):
    rows_in = [("a", START, 1, "in"), ("a", START, 1, "in"), (None, START, 2, "in"), ("a", None, 3, "out"), ("a", START, 4, None), ("b", START, 5, "out")]
    df = spark.createDataFrame(rows_in, SCHEMA)
    assert [x[0:1] + x[2:] for x in rows(folds.fold_table(df, "src", "ts", "eid", "what", folds.Membership()))] == [("a", 1, "in", "entered", 1)]
    assert folds.fold_table(df.limit(0), "src", "ts", "eid", "what", folds.Membership()).count() == 0
