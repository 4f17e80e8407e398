"""Readers on small samples of our own, sinks, and streams against batch."""

import os

from pyspark.sql import functions as F

from palimpsest.operators import changes
from palimpsest.sources import readers, sinks
from palimpsest.streaming import streams


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"studies":[{"protocolSection":{"identificationModule":{"nctId":"N1","briefTitle":"T"},"statusModule":{"overallStatus":"NOT_YET_RECRUITING","startDateStruct":{"date":"2024-05"}},"designModule":{"phases":["PHASE1","PHASE2"],"enrollmentInfo":{"count":7}}}}]}')
    r = readers.normalise_json_study(readers.read_landed_json(spark, str(tmp_path / "a.json"), "studies")).first()
    assert (r["source_trial_id"], r["status"], r["phase"], r["enrollment"], r["start_date"]) == ("N1", "Not Yet Recruiting", "Phase 1/Phase 2", 7, "2024-05-01")
    (tmp_path / "b.xml").write_text("<Trials><Trial><TrialID>I1</TrialID><Public_title>P</Public_title><Target_size>1,200</Target_size><Countries>A;B</Countries><Date_registration>05/11/2024</Date_registration></Trial></Trials>")
    x = readers.normalise_aggregator(readers.read_xml(spark, str(tmp_path / "b.xml"), "Trial", "TrialID string, Public_title string, Target_size string, Countries string, Date_registration string")).first()
    assert (x["source_trial_id"], x["title"], x["enrollment"], x["countries"], x["registration_date"]) == ("I1", "P", 1200, '["A","B"]', "2024-11-05")
    assert readers.light_record(readers.normalise(spark.range(1), "S", {"phase": F.lit("Ⅱ期"), "conditions": F.lit("a;b")})).first()["phase_bucket"] == "Phase 2"


def test_text_blocks_and_html(spark, rows, tmp_path):
    (tmp_path / "e.txt").write_text("head\nNumber: 1\nTitle: a: b\nNumber: x\n\nNumber: 2\nTitle: c\n".replace("Number: x", "Other: y"))
    got = readers.read_text_blocks(spark, str(tmp_path / "e.txt"), "Number")
    assert rows(got.select(F.col("fields")["Number"], F.col("fields")["Title"])) == [("1", "a: b"), ("2", "c")]
    html = "<table><tr><th>Name:</th><td>x<br>y</td></tr><tr><td>Name</td><td>longer &amp; more</td></tr></table>"
    pages = spark.createDataFrame([(1, html), (2, None)], "id long, h string")
    assert readers.label_values(html) == {"Name": "longer & more"}
    assert readers.parse_details(pages, "id", "h").filter("id = 1").first()["fields"] == {"Name": "longer & more"}
    assert rows(readers.parse_grid(pages, "id", "h").select("id", "row")) == [(1, 0), (1, 1)]


def test_downgrades(spark, rows):
    new = spark.createDataFrame([("a", True), ("b", True), ("a", False)], "k string, thin boolean")
    old = spark.createDataFrame([("a",)], "k string")
    assert rows(readers.without_downgrades(new, old, "k", F.col("thin"))) == [("a", False), ("b", True)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None)], "id long, l array<string>, n string")
    sinks.csv_export(df, str(tmp_path / "csv"))
    parts = [(tmp_path / "csv" / p).read_text(encoding="utf-8") for p in os.listdir(tmp_path / "csv") if p.endswith(".csv")]
    text = max(parts, key=len)
    assert text.startswith("﻿id,l,n\n1,a; b,")
    sent = []
    send = lambda d: sent.append(d.count())
    pending = spark.createDataFrame([(1, "mail"), (1, "mail"), (2, "app")], "e long, c string")
    assert sinks.deliver(pending, str(tmp_path / "ledger"), ["e", "c"], send) == 2
    assert sinks.deliver(pending, str(tmp_path / "ledger"), ["e", "c"], send) == 0 and sent == [2]
    assert "| 1 | ['a', 'b'] |  |" in sinks.markdown_table(df)


def test_stream_equals_batch(spark, rows, tmp_path):
    data = [("u1", 1, "a", "2024-01-01 00:00:00"), ("u1", 2, "a", "2024-01-01 01:00:00"), ("u1", 3, "b", "2024-01-01 02:00:00"), ("u2", 4, "a", "2024-01-01 00:30:00"), ("u2", 5, "c", "2024-01-01 03:00:00")]
    df = spark.createDataFrame(data, "u string, i long, s string, t string").withColumn("t", F.to_timestamp("t"))
    src = str(tmp_path / "in")
    df.write.parquet(src)
    stream = streams.stream_changes(streams.read_events(spark, src, df.schema), "u", "t", "i", "s")
    q = stream.writeStream.format("memory").queryName("changes_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = changes.detect_changes(df, ["u"], ["t", "i"], ["s"], carry=["i"])
    assert rows(spark.table("changes_out").select("key", "event_id", "old_value", "new_value")) == rows(batch.select("u", "i", "old_value", "new_value"))
    for _ in range(2):
        streams.write_once(streams.read_events(spark, src, df.schema), str(tmp_path / "out"), str(tmp_path / f"cp{_}"), ["u"], ["i"]).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("u", "i")) == [("u1", 1), ("u2", 4)]
    w = streams.windowed_counts(streams.read_events(spark, src, df.schema), "t", ["u"], "1 hour")
    q = w.writeStream.format("memory").queryName("w_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w_out").count() == 5


def test_registry_mappings(spark, tmp_path):
    import json

    from palimpsest.sources import mappings

    status = {"2": "Registered", "7": None, "Ongoing, recruiting": "Recruiting", "Ongoing, recruitment ended": "Completed", "Not yet recruiting": "Recruiting", "Authorised": "Registered", "Halted": "Halted", "": None}
    df = spark.createDataFrame([(k,) for k in status], "s string")
    assert {r[0]: r[1] for r in df.select("s", mappings.ctis_status(F.col("s"))).collect()} == status
    detail = {"ctNumber": "2026-525681-22-00", "authorizedApplication": {"authorizedPartI": {"products": [{"productName": "P", "productDictionaryInfo": {"activeSubstanceName": "S"}}], "sponsors": [{"organisation": {"name": "Org"}}], "trialDetails": {"clinicalTrialIdentifiers": {"publicTitle": "T", "fullTitle": "Full"}, "trialInformation": {"medicalCondition": {"partIMedicalConditions": [{"medicalCondition": "m"}]}, "trialDuration": {"estimatedRecruitmentStartDate": "2026-03-01"}}}}, "authorizedPartsII": [{"mscInfo": {"countryName": "France"}}, {"mscInfo": {"countryName": "France"}}]}}
    r = mappings.normalise_ctis(spark.createDataFrame([(json.dumps({"_search": {"ctStatus": 2, "totalNumberEnrolled": "1,200"}, "_detail": detail}),)], "raw_payload string")).first()
    assert (r["source_trial_id"], r["title"], r["status"], r["enrollment"], r["start_date"], r["countries"], r["interventions"], r["conditions"], r["sponsors"]) == ("2026-525681-22-00", "T", "Registered", 1200, "2026-03-01", '["France"]', '["P","S"]', '["m"]', '["Org"]')
    (tmp_path / "i.xml").write_text('<all><trial publicIdentifierCanonical="71771495" publicIdentifierDateAssigned="2024-01-05"><trialDescription><title>T</title></trialDescription><trialDesign><primaryStudyDesign>Interventional</primaryStudyDesign><overallEndDate>2030-01-01</overallEndDate></trialDesign><participants><recruitmentStart>2024-02-01</recruitmentStart><targetEnrolment>40</targetEnrolment><recruitmentCountries><country>UK</country><country>France</country></recruitmentCountries></participants><interventions><intervention><drugNames>d</drugNames><phase>Phase II</phase></intervention></interventions></trial></all>')
    x = mappings.normalise_isrctn(readers.read_xml(spark, str(tmp_path / "i.xml"), "trial", mappings.ISRCTN_SCHEMA), "2024-06-01").first()
    assert (x["source_trial_id"], x["status"], x["phase"], x["enrollment"], x["registration_date"], x["countries"], x["interventions"]) == ("ISRCTN71771495", "Recruiting", "Phase II", 40, "2024-01-05", '["UK","France"]', '["d"]')
    (tmp_path / "e.txt").write_text("EudraCT Number: 2019-000001-12\nFull Title: A: b\nSponsor Name: S\nStart Date: 2019-05-06\nTrial protocol: DE (Ongoing) FR (Completed)\n\nEudraCT Number: none\n")
    e = mappings.normalise_euctr(readers.read_text_blocks(spark, str(tmp_path / "e.txt"), "EudraCT Number")).collect()
    assert [(y["source_trial_id"], y["title"], y["status"], y["start_date"], y["countries"]) for y in e] == [("2019-000001-12", "A: b", "Active, not recruiting", "2019-05-06", '["DE","FR"]')]


def test_small_pieces(spark, rows, tmp_path):
    from palimpsest.operators import glossary, intel, writes

    one = spark.createDataFrame([("100", "150", "2024-01-01", "2024-01-31")], "a string, b string, c string, d string")
    deltas, days = changes.value_deltas(F.col("a"), F.col("b")), changes.value_deltas(F.col("c"), F.col("d"))
    assert tuple(one.select(deltas["delta"], deltas["percent"], days["days"], days["delta"]).first()) == (50.0, 50.0, 30, None)
    added, removed = intel.list_diff(F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z")))
    assert tuple(one.select(added, removed).first()) == (["z"], ["x"])
    assert intel.briefing({"changes": one, "none": one.limit(0)}) == ["changes: 1"]
    titles = spark.createDataFrame([(1, 10, "心肌炎"), (1, 11, "myocarditis"), (2, 12, "alone")], "e long, r long, t string")
    assert rows(glossary.sibling_pairs(titles, "e", "r", "t")) == [("心肌炎", "myocarditis", 11)]
    ids = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03")], "id long, d string")
    assert rows(writes.without_phantoms(ids, ids.filter("id = 2"), "id").select("id")) == [(1,), (3,)]
    assert rows(readers.since_day(ids, "d", "2024-01-02").select("id")) == [(2,), (3,)]
    page = spark.createDataFrame([("about 1,234 records",), ("共 56 条",), ("none",)], "h string")
    assert [r[0] for r in page.select(readers.site_total(F.col("h"))).collect()] == [1234, 56, None]
    assert sinks.keyed_details(ids.limit(1), ["id", "d"]).first()["key"] == "1:2024-01-01"
    sinks.json_export(ids, str(tmp_path / "j"), "d")
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    sinks.archive(ids, str(tmp_path / "a"), "d"), sinks.archive(ids.limit(1), str(tmp_path / "a"), "d")
    assert spark.read.parquet(str(tmp_path / "a")).count() == 4
    many = spark.range(60).select(F.concat(F.lit("g"), F.col("id")).alias("g"), F.col("id").alias("n"))
    assert len(sinks.digest_text(many, "g", "n", "T").split("\n")) == 61
    times = spark.createDataFrame([("a", "2024-01-01 00:00:00", "h"), ("a", "2024-01-01 00:20:00", "h"), ("a", "2024-01-01 03:00:00", "i")], "k string, t string, x string").withColumn("t", F.col("t").cast("timestamp"))
    assert rows(streams.session_counts(times, "t", ["k"], "1 hour").select("n")) == [(1,), (2,)]
    sent = []
    first = sinks.deliver(ids, str(tmp_path / "ledger"), ["id"], lambda df: sent.append(df.count()))
    assert (first, sinks.deliver(ids, str(tmp_path / "ledger"), ["id"], sent.append), sent) == (3, 0, [3])
