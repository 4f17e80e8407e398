"""Bounded lists, snapshots, preferences, the index over time, and queries without SQL."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import intel, monitors, quality, trigram_index, versions
from palimpsest.plans import registry
from palimpsest.sources import sinks

SF = "/root/testdata/sf0.001"


def test_lists_are_bounded_and_counts_are_not(spark):
    df = spark.range(500).select(F.lit("hot").alias("k"), (499 - F.col("id")).alias("v")).unionByName(spark.createDataFrame([("b", 7), ("b", 5), ("c", 1), (None, 4), (None, 4)], "k string, v long"))
    got = {r["k"]: (r["n"], r["ids"]) for r in quality.duplicate_keys(df, ["k"], F.col("v"), most=3).collect()}
    assert got == {"hot": (500, "0,1,2"), "b": (2, "5,7"), None: (2, "4,4")}
    partners = {r["k"]: (r["n_partners"], r["partners"]) for r in quality.several_partners(df, ["k"], "v", most=2).collect()}
    assert partners == {"hot": (500, "0,1"), "b": (2, "5,7")}
    assert quality.duplicate_rows(df, ["k"]).count() == 504
    rows = spark.createDataFrame([(1, f"s{i}", i) for i in range(60)] + [(2, "a", 1), (2, "a", 2), (3, "a", 1), (3, "b", 1)], "m long, s string, r long")
    assert {(r["m"], r["sources"], r["n_sources"], r["n_records"]) for r in intel.mirror_groups(rows, "m", "s", "r", most=2).collect()} == {(1, "s0,s1", 60, 60), (3, "a,b", 2, 1)}
    assert versions.first_members(df.limit(0), ["k"], F.col("v")).count() == 0


def test_conflict_values(spark):
    rows = [(1, "a", "x"), (1, "b", "y"), (1, "c", "y"), (2, "a", "x"), (2, "a", "y"), (3, "a", "x"), (3, "b", None), (4, "a", "x"), (4, "b", "x")]
    got = sorted(tuple(r) for r in intel.conflict_values(spark.createDataFrame(rows, "m long, s string, f string"), "m", "s", ["f"]).collect())
    assert got == [(1, "f", "x", 1, "a"), (1, "f", "y", 2, "b")]


def test_conflicts_equal_loops(spark):
    r = random.Random(4)
    rows = [(r.choice([None, 1, 2, 3, 4]), r.choice([None, "a", "b", "c"]), r.choice([None, "x", "y", "z"]), r.choice([None, 1, 2])) for _ in range(40)]
    df = spark.createDataFrame(rows, "m long, s string, f string, g int")
    values, pairs = {}, {}
    for i, name in ((2, "f"), (3, "g")):
        for m in {x[0] for x in rows} - {None}:
            held = {(x[1], str(x[i])) for x in rows if x[0] == m and x[1] is not None and x[i] is not None}
            if len({v for _, v in held}) > 1 and len({s for s, _ in held}) > 1:
                values |= {(m, name, v): (len({s for s, w in held if w == v}), min(s for s, w in held if w == v)) for _, v in held}
            for a, b in {(a[0], b[0]) for a in held for b in held if a[0] < b[0] and a[1] != b[1]}:
                masters, n = pairs.get((name, a, b), (0, 0))
                pairs[name, a, b] = (masters + 1, n + sum(x[0] == a and y[0] == b and x[1] != y[1] for x in held for y in held))
    got = intel.conflict_values(df, "m", "s", ["f", "g"])
    assert {tuple(x)[:3]: tuple(x)[3:] for x in got.collect()} == values and values
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    counted = intel.conflict_counts(df, "m", "s", ["f", "g"])
    assert {tuple(x)[:3]: tuple(x)[3:] for x in counted.select("field_name", "source_a", "source_b", "masters", "pairs").collect()} == pairs and pairs
    # after the arrays only pairs of sources are grouped, not masters
    last = counted._jdf.queryExecution().executedPlan().toString().split("ObjectHashAggregate")[0]
    assert "HashAggregate(keys=[field_name" in last and ", m#" not in last


def test_digest_of_many_groups(spark):
    counts = spark.range(30).select(F.col("id").cast("string").alias("g"), F.col("id").alias("n"))
    assert sinks.digest_text(counts, "g", "n", "T").split("\n")[:2] == ["T", "- 29: 29"]
    with pytest.raises(ValueError, match="digest_rows"):
        sinks.digest_text(counts, "g", "n", "T", most=29)
    assert sinks.digest_rows(counts, "g", "n").filter("line = '- 3: 3'").count() == 1


def test_snapshots_are_verified_kept_and_restored(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/snap"
    df = spark.createDataFrame([(1, None), (2, "b"), (2, "b")], "id long, t string")
    with pytest.raises(FileNotFoundError):
        sinks.restore(spark, root)
    for k in range(5):
        sinks.snapshot(df.withColumn("k", F.lit(k)), root, f"2026010{k}", keep=3)
    assert sinks.snapshots(spark, root) == ["20260102", "20260103", "20260104"]
    assert sinks.restore(spark, root).first()["k"] == 4 and sinks.restore(spark, root, "20260102").count() == 3
    with pytest.raises(FileNotFoundError):
        sinks.restore(spark, root, "20260100")
    told = iter([(3, 1), (3, 2)])
    monkeypatch.setattr(sinks, "_content", lambda _: next(told))
    with pytest.raises(RuntimeError, match="differs"):
        sinks.snapshot(df, root, "20260109", keep=1)
    assert sinks.snapshots(spark, root) == ["20260102", "20260103", "20260104"]


def test_preferences(spark):
    events = spark.createDataFrame([(1, "t", "status", "critical"), (2, "t", "status", "normal"), (3, "t", "date", "minor"), (4, "t", "date", "normal"), (5, "u", "status", "critical")], "eid long, trial string, g string, sev string")
    watches = spark.createDataFrame([("w1", "t"), ("w2", "t"), ("w3", "u")], "watch_id string, trial string")
    chosen = spark.createDataFrame([("w1", "status", True, "important"), ("w2", "status", False, None), ("w2", "date", None, "minor")], "watch_id string, field_group string, enabled boolean, minimum_severity string")
    got = sorted((r["watch_id"], r["eid"]) for r in monitors.preferred_events(events, watches, chosen, "trial", F.col("g"), F.col("sev")).collect())
    assert got == [("w1", 1), ("w1", 4), ("w2", 3), ("w2", 4), ("w3", 5)]


def test_index_over_time_equals_scans(spark, tmp_path):
    r = random.Random(2)
    word = lambda: r.choice(["alpha", "beta", "Gamma", "délta", "中文字", "x", "io"])
    index = trigram_index.TrigramIndex(spark, f"file://{tmp_path}/index", "id", "body")
    with pytest.raises(FileNotFoundError):
        index.postings()
    now: dict[int, str | None] = {}
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, body string")
    for number in range(1, 6):
        fresh = {r.randrange(40): r.choice([None, "", " ".join(word() for _ in range(4))]) for _ in range(15)}
        gone = r.sample(range(40), 4)
        now = {k: v for k, v in now.items() if k not in gone} | fresh
        index.apply(number, frame(fresh), spark.createDataFrame([(g,) for g in gone], "id long"))
        index.apply(number, frame({1: "ignored"}))  # taken already
        if number in (3, 5):
            index.compact()
        records = frame(now)
        for phrase in ("alpha b", "ÉLTA", "中文字", "io", "nowhere"):
            want = sorted(k for k, v in now.items() if v and phrase.lower() in v.lower())
            assert sorted(x["id"] for x in index.search(records, phrase).collect()) == want
        grams = {(k, v.lower()[i : i + 3]) for k, v in now.items() if v for i in range(len(v) - 2)}
        assert sorted(map(tuple, index.postings().select("key", "gram").collect())) == sorted(grams)
    index.apply(9, frame({77: "alpha beta"}))
    with pytest.raises(ValueError, match="later one"):
        index.apply(7, frame({1: "x"}))
    assert [x["id"] for x in index.candidates("pha bet").filter("id = 77").collect()] == [77]


def test_queries_without_sql_on_a_given_table(spark):
    q = registry.queries()
    import pyarrow.parquet as pq

    from palimpsest.operators.arrival import PartState

    parts = pq.read_table(f"{SF}/part.parquet").to_pylist()
    state, want = PartState(), {}
    for p in sorted(parts, key=lambda p: (p["p_retailprice"], p["p_partkey"])):
        ids = [("name", p["p_name"], 1.0), ("kind", p["p_brand"] + "/" + p["p_type"], 0.6)]
        row = state.resolve(p["p_partkey"], False, ids, [])
        want[row[0]] = row[1:]
    assert {r["record"]: tuple(r)[1:] for r in q["resolution_of_parts"](spark, SF).collect()} == want and {"queued", "linked", "created"} <= {x[0] for x in want.values()}

    events = pq.read_table(f"{SF}/events.parquet").to_pylist()
    opened, streak, out = {}, {}, []
    for e in sorted(events, key=lambda e: (e["user_id"], e["ts"], e["event_id"])):
        u, at = e["user_id"], int(e["ts"].timestamp() * 1000) if e["ts"].tzinfo else None
        at = at or int((e["ts"] - __import__("datetime").datetime(1970, 1, 1)).total_seconds() * 1000)
        if u in opened and at >= opened[u] + 86_400_000:
            out.append((str(u), opened.pop(u) + 86_400_000, -1, "reset"))
            streak[u] = 0
        if u in opened:
            out.append((str(u), at, e["event_id"], "refused"))
            continue
        streak[u] = streak.get(u, 0) + 1 if e["event_type"] == "error" else 0
        if streak[u] >= 2:
            opened[u] = at
        out.append((str(u), at, e["event_id"], "opened" if streak[u] >= 2 else "passed"))
    assert sorted((r["key"], r["at"], r["id"], r["state"]) for r in q["breaker_states"](spark, SF).collect()) == sorted(out)
    issues = {r["issue"]: r["n"] for r in q["missed_merges"](spark, SF).groupBy("issue").agg(F.count("*").alias("n")).collect()}
    assert {"same_protocol_diff_master"} <= set(issues)
