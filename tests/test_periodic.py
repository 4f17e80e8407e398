"""A periodic run over a landed feed, twice, with a failure between; searches with fallback and glossary terms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import glossary, monitors, periodic

SCHEMA = "nct string, updated string, rid long, title string, status string, payload string"
FIRST = [("NCT00000001", "2026-01-01", 1, "lung one", "open", "{}"), ("NCT00000002", "2026-01-02", 2, "lung two", "open", '{"x": "see NCT00000001"}'), ("ISRCTN00000003", "2026-01-02", 3, "heart", None, "{}")]
SECOND = [("NCT00000001", "2026-01-05", 4, "lung one", "done", "{}"), ("NCT00000009", "2026-01-06", 5, "lung nine", "open", "{}")]


def test_two_runs_and_a_failure(spark, tmp_path):
    clock = iter(dt.datetime(2026, 1, 1) + dt.timedelta(minutes=k) for k in range(200))
    feed = periodic.Feed("nct", "nct", "updated", "rid", ["title", "status"], "payload", F.col("title").contains("lung"), ["lung"])
    run = lambda rows, name: periodic.periodic_run(spark, f"file://{tmp_path}/feed", feed, spark.createDataFrame(rows, SCHEMA), name, lambda: next(clock))
    one = run(FIRST, "first")
    assert one["run"].status == "succeeded" and one["run"].cursor_after == "2026-01-02" and one["events"].count() == 0
    assert {r["record"]: (r["action"], r["master"]) for r in one["resolved"].collect()} == {1: ("created", 1), 2: ("linked", 1), 3: ("created", 3)}
    assert sorted(r["nct"] for r in one["report"].collect()) == ["NCT00000001", "NCT00000002"]
    assert {r["field_name"]: r["missing"] for r in one["missing"].collect()} == {"title": 0, "status": 1}
    assert run(FIRST, "first")["run"].status == "already_claimed"
    lost = run([], "lost")
    assert lost["run"].status == "failed" and list(lost) == ["run"]
    two = run(FIRST + SECOND, "second")
    assert two["run"].cursor_before == "2026-01-02" and two["run"].cursor_after == "2026-01-06"
    assert [(r["nct"], r["field_name"], r["old_value"], r["new_value"]) for r in two["events"].collect()] == [("NCT00000001", "status", "open", "done")]
    assert sorted((r["nct"], r["change"]) for r in two["report"].collect()) == [("NCT00000001", "changed"), ("NCT00000009", "new")]
    assert two["latest"].count() == 4


def test_report_modes(spark):
    rows = spark.createDataFrame([(1, "a", "2026-01-01"), (2, "b", "2026-01-05"), (3, "c", "2026-01-09")], "k long, s string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    base = spark.createDataFrame([(1, "a"), (2, "x")], "k long, s string")
    run = lambda **mode: sorted((r["k"], r["change"]) for r in monitors.baseline_report(rows, "k", "s", "at", **mode).collect())
    assert run() == [(1, None), (2, None), (3, None)] and run(force=True, generated="2026-01-05") == run()
    assert run(since="2026-01-05") == [(2, None), (3, None)] == run(generated="2026-01-05") == run(since="2026-01-05", baseline=base, force=True)
    assert run(baseline=base) == [(2, "changed"), (3, "new")]
    assert run(baseline=base, force=True) == [(1, "unchanged"), (2, "changed"), (3, "new")]
    assert monitors.report_key(["B ", "a", "b", ""]) == "a|b" == monitors.report_key(["A", "B"])


def test_fallback_in_one_plan(spark):
    df = spark.createDataFrame([(1, "small gold ring", "x"), (2, "ring of small", "y"), (3, "anneau", "x"), (4, "smallring", "z")], "id long, name string, kind string")
    columns = {"query": ["name"], "sponsor": "kind"}
    ids = lambda d: sorted((r["id"], r["branch"]) for r in d.collect())
    search = lambda rows, q, **more: ids(glossary.search_with_fallback(rows, {"query": q}, {"query": ["name"]}, {"ring": "anneau"}, ["small", "ring"], **more))
    assert search(df, "smallring") == [(4, "base")]  # a whole match keeps the parts out
    assert search(df.filter("id < 4"), "smallring") == [(1, "segments"), (2, "segments")]
    assert search(df.filter("id <= 3"), "ring") == [(1, "base"), (2, "base"), (3, "translated")]
    learned = spark.createDataFrame([("small", "anneau", 3, "active"), ("ring", "gold", 9, "candidate"), ("gold", "of", 2, "active")], "zh_term string, en_term string, evidence long, status string")
    assert search(df.filter("id <= 3"), "Small", learned=learned) == [(1, "base"), (2, "base"), (3, "translated")]
    retired = glossary.retire(learned, learned.filter("zh_term = 'small'"))
    assert search(df.filter("id <= 3"), "small", learned=retired) == [(1, "base"), (2, "base")]
    assert {r["zh_term"]: r["status"] for r in retired.collect()} == {"small": "retired", "ring": "candidate", "gold": "active"}
    totals = glossary.search_totals(df, {"query": "ring"}, {"query": ["name"]}, {}).first()
    assert (totals["total"], totals["unfiltered_total"]) == (3, 3)
