"""Identifier steps, integrity checks, the overview and master matches on small tables."""

import datetime as dt
import json

from pyspark.sql import functions as F

from palimpsest.operators import feeds, integrity, resolve, scopes


def test_identifier_steps_in_order(spark):
    nct = {"protocolSection": {"identificationModule": {"secondaryIdInfos": [{"secondaryId": "2019-000001-12"}, {"id": "AB-12X9"}]}, "sponsorCollaboratorsModule": {"leadSponsor": {"name": "Acme"}}}, "note": "see ISRCTN12345678"}
    ctis = {"_detail": {"ctNumber": "2026-525681-22-00", "authorizedApplication": {"authorizedPartI": {"trialDetails": {"clinicalTrialIdentifiers": {"secondaryIdentifyingNumbers": {"additionalRegistries": [{"registryNumber": "nct00000009"}, "U1111-1234-5678"]}}}}}}}
    who = {"_aggregator": {"_who_source_trial_id": "ChiCTR2600131888"}, "secondary_ids": ["CTR20263443", ""]}
    data = [(1, "NCT00000001", json.dumps(nct)), (2, "2026-525681-22-00", json.dumps(ctis)), (3, "ICTRP-1", json.dumps(who)), (4, "NCT00000004", "code QX7-123A here, ZZ-9999"), (5, None, None)]
    got = resolve.record_identifiers(spark.createDataFrame(data, "record long, own string, payload string"), "record", "own", "payload").collect()
    of = lambda n: [(r["type"], r["value"], r["field"], r["confidence"]) for r in sorted(got, key=lambda r: r["nth"]) if r["record"] == n]
    assert of(1) == [("NCT", "NCT00000001", "own", 1.0), ("EudraCT", "2019-000001-12", "secondary_id", 0.95), ("ProtocolNumber", "AB-12X9", "secondary_id", 0.95), ("ProtocolNumber", "Acme", "lead_sponsor", 0.7), ("ISRCTN", "ISRCTN12345678", "raw_payload", 0.8)]
    assert of(2) == [("CTIS", "2026-525681-22-00", "own", 1.0), ("NCT", "NCT00000009", "ctis_secondary_id", 0.95), ("UTN", "U1111-1234-5678", "ctis_secondary_id", 0.95), ("ProtocolNumber", "U1111-1234-5678", "raw_payload", 0.6)]
    assert of(3) == [("ProtocolNumber", "ICTRP-1", "own", 1.0), ("ChiCTR", "ChiCTR2600131888", "who_aggregator", 1.0), ("CTR", "CTR20263443", "secondary_id", 0.95)]
    assert of(4) == [("NCT", "NCT00000004", "own", 1.0), ("ProtocolNumber", "QX7-123A", "raw_payload", 0.6)] and of(5) == []


def test_integrity_checks(spark):
    t = dt.datetime(2024, 1, 31, 0, 0)
    tables = {
        "notifications": spark.createDataFrame([(1, "email", "sending", None, t - dt.timedelta(hours=3)), (1, "email", "sent", t, None), (9, "in_app", "pending", None, None)], "monitor_event_id long, channel string, status string, read_at timestamp_ntz, claimed_at timestamp_ntz"),
        "monitor_events": spark.createDataFrame([(1, 1, 5), (2, 7, None), (3, 1, 99)], "id long, monitor_id long, related_change_event_id long"),
        "monitors": spark.createDataFrame([(1,)], "id long"),
        "trial_events": spark.createDataFrame([(5, "h", 1, "f", None, "x", t), (6, "h", 1, "f", "", "x", t)], "event_id long, event_hash string, record_id long, field_name string, old_value string, new_value string, detected_at timestamp_ntz"),
        "registry_records": spark.createDataFrame([("S", "a", 1, True), ("S", "a", 2, False), ("S", "b", 1, True), ("S", "b", 1, True)], "source string, source_trial_id string, version_number int, is_latest boolean"),
        "project_trials": spark.createDataFrame([("a", "S"), ("a", "T")], "trial_id string, source string"),
        "ingestion_runs": spark.createDataFrame([("S", "running", None, None, t, None), ("S", "running", t, None, t, None), ("T", "failed", t, "c", t, None)], "source string, status string, finished_at timestamp_ntz, cursor_after string, started_at timestamp_ntz, scheduled_for timestamp_ntz"),
    }
    got = {r["code"]: r["n"] for r in integrity.integrity(tables, "2024-01-31 01:00:00").collect()}
    assert got == {
        "NOTIFICATION_EVENT_MISSING": 1, "MONITOR_EVENT_MONITOR_MISSING": 1, "MONITOR_EVENT_TRIAL_EVENT_MISSING": 1, "PROJECT_TRIAL_MISSING": 1, "DUPLICATE_EVENT_HASH": 1, "DUPLICATE_LOGICAL_EVENT": 1,
        "DUPLICATE_REGISTRY_VERSION": 1, "INVALID_LATEST_VERSION": 1, "DUPLICATE_INGESTION_OCCURRENCE": 0, "DUPLICATE_NOTIFICATION": 1, "MULTIPLE_RUNNING_INGESTIONS": 1, "IMPOSSIBLE_INGESTION_STATE": 2,
        "INVALID_NOTIFICATION_STATE": 1, "INVALID_NOTIFICATION_READ_STATE": 1, "STALE_INGESTION": 0, "STALE_EMAIL_CLAIM": 1,
    }


def test_overview_of_a_small_corpus(spark, rows):
    day = lambda d: dt.datetime(2026, 9, d, 12)
    data = [(1, 1, "status_id", "Recruiting", "Completed", "important", day(18)), (2, 1, "enrollment", "100", "150", "important", day(19)), (3, 1, "primary_endpoint", "a", "b", "critical", day(19)), (4, 1, "countries", "[]", '["United States"]', "important", day(20))]
    events = spark.createDataFrame(data, "event_id long, trial long, field_name string, old_value string, new_value string, severity string, ts timestamp_ntz").withColumn("source", F.lit("NCT"))
    members = spark.createDataFrame([("entered",), ("left",)], "change string")
    current = spark.createDataFrame([(1, False, "Phase 2", 0), (2, True, None, 0), (2, True, "Phase 3", 1)], "trial long, is_new boolean, phase string, rank int")
    got = feeds.overview(events, members, current, "trial", "ts", "source", F.col("field_name"))
    c = got["counts"].first()
    assert (c["change_events"], c["changed_entities"], c["new_entities"], c["current_entities"], c["entered"], c["left"], c["reentered"]) == (4, 1, 1, 2, 1, 1, 0)
    assert (c["outcome_changes"], c["enrollment_changes"], c["country_changes"], c["critical"], c["important"]) == (1, 1, 1, 1, 3)
    d = got["deltas"].first()
    assert (d["delta"], d["percent"]) == (50, 50.0)
    assert rows(got["transitions"]) == [("Recruiting", "Completed", 1, [1])] and rows(got["busiest"].select("trial", "n_events", "top_rank")) == [(1, 4, 4)]
    assert rows(got["phases"]) == [("Phase 2", 1), ("Unknown", 1)] and [r["event_id"] for r in got["priority"].collect()] == [4, 2, 3, 1]
    report = {(r["section"], r["name"], r["part"]): r["n"] for r in got["report"].collect()}
    assert report[("total", "", None)] == 4 and report[("trend", "2026-09-19", "critical")] == 1 and report[("registry", "NCT", None)] == 4


def test_master_matches_rank_titles_last(spark, rows):
    ids = spark.createDataFrame([(1, "NCT", "N1", 0.8, 1), (2, "NCT", "N1", 1.0, 0), (1, "ProtocolNumber", "P", 0.6, 2), (3, "ProtocolNumber", "P", 0.6, 0), (4, "ProtocolNumber", "Q", 0.7, 0)], "record long, type string, value string, confidence double, nth int")
    masters = spark.createDataFrame([(2, "m2"), (3, "m3"), (5, "m5")], "record long, master string")
    titles = spark.createDataFrame([(5, 1, 0.99), (5, 4, 0.93)], "a long, b long, ratio double")
    got = resolve.master_matches(ids, masters, "record", titles)
    assert rows(got.select("record", "master", "confidence", "status", "rank")) == [(1, "m2", 0.8, "AUTO_CONFIRMED", 1), (1, "m3", 0.6, "POSSIBLE", 2), (4, "m5", 0.93, "POSSIBLE", 1)]


def test_as_of_takes_the_last_value(spark, rows):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "k long, t long, x string")
    right = spark.createDataFrame([(1, 2, 10.0, 1), (1, 5, 20.0, 2), (1, 5, 30.0, 3), (1, 6, 40.0, 4), (2, 3, None, 5)], "k long, t long, v double, tie long")
    assert rows(scopes.as_of(left, right, ["k"], "t", "v", "tie").select("k", "t", "x", "v")) == [(1, 1, "b", None), (1, 5, "a", 30.0), (2, 9, "c", None)]


def test_master_matches_of_profiles_equal_loops(spark):
    import random

    r = random.Random(5)
    ids = [(rec, kind, f"{kind}{r.randrange(4)}", r.choice([0.6, 0.95]), nth) for rec in range(60) for nth, kind in enumerate(r.sample(["CTR", "ProtocolNumber", "Other"], r.randrange(1, 4)))]
    ids += [(100 + i, "Other", "own", 0.6, 1) for i in range(1)] + [(i, "CTR", "all", 0.7, 1) for i in range(200, 230)]
    masters = [(rec, f"m{rec % 7}") for rec in sorted({x[0] for x in ids})]
    of = dict(masters)
    want = []
    for rec in of:
        best = {}
        for _, kind, value, confidence, nth in sorted((x for x in ids if x[0] == rec), key=lambda x: (x[4], x[1], x[2])):
            for m in {of[y[0]] for y in ids if y[1:3] == (kind, value) and y[0] != rec}:
                best.setdefault(m, ("AUTO_CONFIRMED" if kind == "CTR" or confidence >= 0.9 else "POSSIBLE", -confidence, m, f"identifier_match {kind}"))
        want += [(rec, m, how, -c, status, k) for k, (status, c, m, how) in enumerate(sorted(best.values()), 1)]
    df = resolve.master_matches(spark.createDataFrame(ids, "record long, type string, value string, confidence double, nth int"), spark.createDataFrame(masters, "record long, master string"), "record")
    assert sorted(tuple(x) for x in df.select("record", "master", "method", "confidence", "status", "rank").collect()) == sorted(want) and len(want) > 200
