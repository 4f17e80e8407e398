"""Interval joins and late versions against loops over all pairs and full recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import intervals, late


def spans(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        start = r.choice([None, *(round(r.uniform(-50, 300), 1) for _ in range(12))])
        out.append((i, r.choice("xxy"), start, None if start is None else start + r.choice([-1, 0, 0.5, 5, 40, 200])))
    return out + out[:2]


@pytest.mark.parametrize("width,most", [(10.0, 100_000), (7.5, 3), (1000.0, 5)])
def test_overlaps_equal_all_pairs(spark, width, most):
    a, b = spans(1, 90), spans(2, 80)
    left = spark.createDataFrame(a, "id long, k string, s double, e double").withColumns({"bucket": F.lit(1), "first": F.lit(2), "part": F.lit("p")})
    right = spark.createDataFrame(b, "id long, k string, s double, e double").withColumns({"bucket": F.lit(1), "r_from": F.lit(2)})
    for on in ((), ("k",)):
        got = intervals.overlap_join(left.repartition(3), right, (F.col("s"), F.col("e")), (F.col("s"), F.col("e")), width, on, most)
        found = sorted((r["l"]["id"], r["r"]["id"]) for r in got.collect())
        real = lambda rows: [x for x in rows if x[2] is not None and x[3] > x[2]]
        want = sorted((x[0], y[0]) for x in real(a) for y in real(b) if x[2] < y[3] and y[2] < x[3] and (not on or x[1] == y[1]))
        assert found == want and len(found) > 200
    assert intervals.overlap_join(left.limit(0), right, (F.col("s"), F.col("e")), (F.col("s"), F.col("e")), width).count() == 0


def test_points_in_ranges(spark):
    r = random.Random(3)
    points = [(i, r.choice([None, 0.0, 10.0, -3.0, r.uniform(-60, 320)])) for i in range(120)]
    ranges = spans(4, 60) + [(900, "x", 0.0, 10.0), (901, "x", 10.0, 20.0), (902, "x", -3.0, 0.0)]
    got = intervals.point_join(spark.createDataFrame(points, "id long, p double"), spark.createDataFrame(ranges, "id long, k string, s double, e double"), F.col("p"), (F.col("s"), F.col("e")), 25.0, most=4)
    want = sorted((i, x[0]) for i, p in points if p is not None for x in ranges if x[2] is not None and x[2] <= p < x[3])
    assert sorted((x["l"]["id"], x["r"]["id"]) for x in got.collect()) == want


VERSION = "k string, at int, id long, status string, size double"
SHAPE = (["k"], ["at", "id"], ["status", "size"])


def versions(seed, n=240):
    r = random.Random(seed)
    return [(r.choice(["hot", "hot", "b", "c", f"k{i % 30}"]), r.randrange(60), i, r.choice(["open", "done", None, ""]), r.choice([1.0, 1.0, 2.0, None])) for i in range(n)]


def key(df):
    return sorted(map(tuple, df.select("k", "at", "id", "field_name", "old_value", "new_value").collect()), key=str)


def test_one_event_becomes_two(spark):
    known = spark.createDataFrame([("a", 1, 1, "open", 1.0), ("a", 9, 2, "done", 1.0), ("b", 1, 3, "open", 1.0)], VERSION)
    fresh = spark.createDataFrame([("a", 5, 4, "hold", 1.0)], VERSION)
    got = sorted((r["op"], r["at"], r["old_value"], r["new_value"]) for r in late.late_delta(known, fresh, *SHAPE).collect())
    assert got == [(-1, 9, "open", "done"), (1, 5, "open", "hold"), (1, 9, "hold", "done")]
    same = spark.createDataFrame([("a", 5, 4, "open", 1.0)], VERSION)  # says what is known: nothing to retract
    assert late.late_delta(known, same, *SHAPE).count() == 0


def test_any_arrival_order_equals_recomputation(spark):
    for seed in range(3):
        rows = versions(seed)
        r = random.Random(seed)
        r.shuffle(rows)
        known, events = spark.createDataFrame([], VERSION), spark.createDataFrame([], "k string, at int, id long, field_name string, old_value string, new_value string")
        at = 0
        while at < len(rows):
            size = r.choice([1, 30, 80])
            fresh = spark.createDataFrame(rows[at : at + size], VERSION)
            events = spark.createDataFrame(late.apply_delta(events, late.late_delta(known, fresh, *SHAPE), *SHAPE[:2]).collect(), events.schema)
            at += size
            known = spark.createDataFrame(rows[:at], VERSION)
        assert key(events) == key(late.change_rows(known, *SHAPE))


def test_change_log_over_a_stream_with_a_restart(spark, tmp_path):
    rows = versions(7)
    random.Random(7).shuffle(rows)
    source, place, checkpoint = (str(tmp_path / x) for x in ("in", "log", "check"))
    log = late.ChangeLog(spark, place, *SHAPE)
    for i in range(4):
        part = rows[i * 60 : i * 60 + 60] + rows[max(0, i * 60 - 5) : i * 60]  # some arrive twice
        spark.createDataFrame(part, VERSION).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(VERSION).parquet(source)
        log.take(stream, checkpoint).awaitTermination(120)  # each time a new query on the checkpoint
        assert key(log.events()) == key(late.change_rows(log.versions(), *SHAPE))
    assert log.versions().count() == len(rows)
    log.add(spark.createDataFrame(rows[:10], VERSION), 0)  # a batch of this number is done
    log.add(spark.createDataFrame(rows, VERSION), 99)  # all are known
    assert log.versions().count() == len(rows)
    assert key(log.events()) == key(late.change_rows(spark.createDataFrame(rows, VERSION), *SHAPE))
