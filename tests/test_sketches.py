"""Stored sketches against exact counts, within the errors they state."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import sketches

DAY = dt.date(2024, 1, 1)


def rows_of(seed=1, n=12_000):
    r = random.Random(seed)
    return [(DAY + dt.timedelta(days=r.choice([0, 1, 2, 3, 5])), r.choice("abbb"), r.choice([None, *(f"u{r.randrange(4000)}" for _ in range(9))]), r.choice([None, r.gauss(50, 20), r.expovariate(0.1)])) for _ in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    rows = rows_of()
    return rows, spark.createDataFrame(rows, "d date, kind string, who string, x double")


def test_windows_stay_within_their_errors(spark, data, tmp_path):
    rows, df = data
    path = str(tmp_path / "days")
    sketches.store_days(sketches.daily_sketches(df, F.col("d"), ["kind"], "who", "x"), path)
    stored = sketches.stored_days(spark, path, "2024-01-01", "2024-01-06")
    assert stored.count() == 10
    for days in (1, 3, 30):
        merged = sketches.merge_sketches(sketches.trailing(stored, days), ["window_end", "kind"])
        for r in sketches.estimates(merged, {"low": 0.1, "median": 0.5, "high": 0.9}).collect():
            held = [x for x in rows if x[1] == r["kind"] and r["window_end"] - dt.timedelta(days=days - 1) <= x[0] <= r["window_end"]]
            exact = len({x[2] for x in held} - {None})
            numbers = [x[3] for x in held if x[3] is not None]
            assert r["n"] == len(held)
            assert abs(r["n_distinct"] - exact) <= 4 * sketches.hll_error() * exact + 1
            for q, name in ((0.1, "low"), (0.5, "median"), (0.9, "high")):
                below, upto = sum(x < r[name] for x in numbers) / len(numbers), sum(x <= r[name] for x in numbers) / len(numbers)
                assert below - 1.5 * sketches.kll_error() <= q <= upto + 1.5 * sketches.kll_error()


def test_windows_end_on_every_day_of_the_table(spark, data):
    _, df = data
    ends = sketches.trailing(sketches.daily_sketches(df, F.col("d"), [], "who", "x"), 2).groupBy("window_end").agg(F.count("*").alias("n"), F.sum("n").alias("rows")).orderBy("window_end").collect()
    assert [(r["window_end"].day, r["n"]) for r in ends] == [(1, 1), (2, 2), (3, 2), (4, 2), (5, 1), (6, 1)]


def test_a_day_written_again_replaces_itself(spark, data, tmp_path):
    _, df = data
    path = str(tmp_path / "again")
    day = lambda rows: sketches.daily_sketches(rows, F.col("d"), [], "who", "x")
    sketches.store_days(day(df), path)
    twice = df.filter("d = DATE'2024-01-02'").limit(7)
    sketches.store_days(day(twice), path)
    got = {r["day"].day: r["n"] for r in sketches.stored_days(spark, path, "2024-01-01", "2024-01-03").select("day", "n").collect()}
    assert got[2] == 7 and got[1] == df.filter("d = DATE'2024-01-01'").count() and set(got) == {1, 2, 3}
    plan = sketches.stored_days(spark, path, "2024-01-02", "2024-01-02")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(DAY, None, None)] * 3, "d date, who string, x double")
    r = sketches.estimates(sketches.merge_sketches(sketches.daily_sketches(df, F.col("d"), [], "who", "x"), ["day"]), {"median": 0.5}).first()
    assert (r["n"], r["n_distinct"], r["median"]) == (3, 0, None)
    assert sketches.daily_sketches(df.limit(0), F.col("d"), [], "who", "x").count() == 0
    assert sketches.count_min(df, ["d"], "who").count() == 0


def test_count_min_is_mergeable_and_never_low(spark, data):
    rows, df = data
    whole = sketches.count_min(df, ["kind"], "who", width=512, depth=4)
    parts = sketches.merge_count_min(sketches.count_min(df.filter("x > 40"), ["kind"], "who", 512, 4).unionByName(sketches.count_min(df.filter("x <= 40 or x is null"), ["kind"], "who", 512, 4)), ["kind"])
    key = lambda d: sorted(map(tuple, d.select("kind", "row", "cell", "n").collect()))
    assert key(whole) == key(parts)
    asked = spark.createDataFrame([(k, f"u{i}") for k in "ab" for i in range(4005)], "kind string, who string")
    exact = Counter((x[1], x[2]) for x in rows if x[2] is not None)
    total = Counter(x[1] for x in rows if x[2] is not None)
    high = 0
    for r in sketches.count_min_estimates(whole, ["kind"], asked, "who", 512, 4).collect():
        true = exact[r["kind"], r["who"]]
        assert r["estimate"] >= true
        high += r["estimate"] > true + 2.72 / 512 * total[r["kind"]]
    assert high <= 8010 * 0.05
