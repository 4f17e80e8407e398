"""Missed merges, durable runs and landed pages."""

import datetime as dt
import json
import os
import random
import threading
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import ingestion, merges
from palimpsest.sources import landed

SCHEMA = "rec long, src string, title string, zh boolean, ks array<string>, m string, size double"


def records_of(seed, n=90):
    r = random.Random(seed)
    bases = [" ".join(r.choice("alpha beta gamma delta trial study of heart lung phase".split()) for _ in range(6)) for _ in range(6)]
    out = []
    for i in range(n):
        title = r.choice(bases)
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(len(title))
            title = title[:k] + r.choice("xyz") + title[k + 1 :]
        title = r.choice([None, title.upper(), title, title, title])
        ks = [r.choice([None, *(f"K{r.randrange(12)}" for _ in range(9)), "every"]) for _ in range(r.randrange(6))]
        out.append((i, r.choice(["c", "c", "d"]), title, r.random() < 0.5, ks, r.choice([None, "m1", "m2", "m3"]), r.choice([None, 0.0, 10.0, 14.9, 15.0, 40.0])))
    return out


def test_evidence_equals_loops(spark):
    rows = records_of(1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(x["a"], x["b"]): x["score"] for x in merges.title_evidence(df, "rec", "title", "m").collect()}
    want = {}
    for x in rows:
        for y in rows:
            if x[5] is None and y[5] is not None and x[2] and y[2]:
                s, t = x[2].lower(), y[2].lower()
                ratio = max(SequenceMatcher(None, s, t).ratio(), SequenceMatcher(None, t, s).ratio())
                if ratio >= 0.92:
                    key = (str(x[0]), y[5])
                    want[key] = max(round(ratio, 4), want.get(key, 0))
    assert got == want and len(got) > 10

    for master in (None, "m"):
        found = sorted((int(x["a"]), int(x["b"]), x["score"], x["detail"]) for x in merges.cross_language_evidence(df, "rec", "src", F.col("zh"), F.col("ks"), master).collect())
        expect = []
        for x in rows:
            for y in rows:
                common = sorted((set(x[4]) & set(y[4])) - {None})
                if x[0] < y[0] and x[1] == y[1] and x[3] != y[3] and len(common) >= 2 and not (master and x[5] is not None and x[5] == y[5]):
                    expect.append((x[0], y[0], float(len(common)), ",".join(common[:5])))
        assert found == sorted(expect) and len(found) > 20

    low = {}
    for x in rows:
        if x[5] and x[6] and x[6] > 0:
            low[x[5]] = min(low.get(x[5], (1e9, 0)), (x[6], x[0]))
    want = sorted((x[5], str(low[x[5]][1]), str(x[0])) for x in rows if x[5] and x[6] and x[6] >= 1.5 * low[x[5]][0])
    assert sorted((x["detail"], x["a"], x["b"]) for x in merges.enrollment_evidence(df, "rec", "m", "size").collect()) == want and want

    ids = spark.createDataFrame([(1, "ProtocolNumber", "P"), (2, "ProtocolNumber", "P"), (3, "ProtocolNumber", "P"), (4, "ProtocolNumber", None), (5, "NCT", "P"), (6, "ProtocolNumber", "Q")], "rec long, type string, value string")
    masters = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "z"), (5, "y"), (6, "a")], "rec long, master string")
    clash = merges.protocol_evidence(ids, masters, "rec")
    assert sorted((x["a"], x["b"], x["score"], x["detail"]) for x in clash.collect()) == [("a", "b", 3.0, "P"), ("a", "c", 3.0, "P")]
    every = merges.missed_merges([merges.title_evidence(df, "rec", "title", "m"), merges.cross_language_evidence(df, "rec", "src", F.col("zh"), F.col("ks")), clash, merges.enrollment_evidence(df, "rec", "m", "size")])
    assert {x["issue"] for x in every.select("issue").distinct().collect()} == {"high_title_similarity", "cross_language_title", "same_protocol_diff_master", "enrollment_discrepancy"}
    assert merges.title_evidence(df.limit(0), "rec", "title", "m").count() == 0


def test_cross_language_classes_cover_all_pairs(spark):
    rows = records_of(2, 60)
    rows += [(100 + r[0], *r[1:4], r[4][::-1], *r[5:]) for r in rows] + [(200 + i, "d", "t", i % 2 == 0, ["P", "Q"], None, 1.0) for i in range(80)]
    df = spark.createDataFrame(rows, SCHEMA)
    for master in (None, "m"):
        every = {(x["a"], x["b"]): (x["score"], x["detail"]) for x in merges.cross_language_evidence(df, "rec", "src", F.col("zh"), F.col("ks"), master).collect()}
        found = merges.cross_language_classes(df, "rec", "src", F.col("zh"), F.col("ks"), master).collect()
        members = {}
        for x in found:
            if x["issue"] == "cross_language_member":
                members.setdefault(x["a"], []).append(x["b"])
        pairs = [x for x in found if x["issue"] == "cross_language_title"]
        spread = {tuple(sorted((a, b), key=int)): (x["score"], x["detail"]) for x in pairs for a in (x["a"], *members.get(x["a"], [])) for b in (x["b"], *members.get(x["b"], []))}
        assert spread == every and len(every) > 1600
        assert len(pairs) < len(every) / 5 and len(found) - len(pairs) < len(rows)


NOW = dt.datetime(2026, 1, 1, 12)


def test_two_claimants_one_wins(spark, tmp_path):
    ledgers = [ingestion.Ledger(spark, f"file://{tmp_path}/runs") for _ in range(8)]
    got = []
    threads = [threading.Thread(target=lambda x=x: got.append(x.claim("feed/a b", "2026-01-01T12:00", NOW).status)) for x in ledgers]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got.count("running") == 1 and set(got) <= {"running", "already_claimed", "busy"}
    assert ledgers[0].claim("feed/a b", "later", NOW).status == "busy"
    assert ledgers[0].claim("feed/a b", "later", NOW + dt.timedelta(hours=3)).status == "running"  # the first is stale by now
    assert [r.status for r in ledgers[0].runs("feed/a b", NOW + dt.timedelta(hours=3))] == ["interrupted", "running"]


def test_cursor_moves_on_success_alone(spark, tmp_path):
    ledger = ingestion.Ledger(spark, f"file://{tmp_path}/runs")
    clock = iter(NOW + dt.timedelta(minutes=k) for k in range(100))
    now = lambda: next(clock)
    seen = []

    def collect(n, cursor, fail=None):
        def run(start):
            seen.append(start)
            if fail:
                raise RuntimeError(fail)
            return ingestion.Found(n, cursor)

        return run

    known = spark.range(3)
    one = lambda name, c, **more: ingestion.run_once(ledger, "nct", name, c, now, known, **more)
    assert one("1", collect(5, "d1")).status == "succeeded"
    assert one("1", collect(5, "d9")).status == "already_claimed"
    assert one("2", collect(0, "d2", "lost")).error == "RuntimeError: lost"
    assert one("3", collect(0, "d3")).status == "failed"  # empty, though records are known
    assert one("4", collect(0, None), allow_empty=True).cursor_after == "d1"
    assert one("5", collect(2, "d5"), full=True).cursor_after == "d5"
    assert one("6", collect(2, "d6"), since="d0").cursor_after == "d6"
    assert one("7", collect(2, None, "again")).status == "failed"
    assert seen == [None, "d1", "d1", "d1", None, "d0", "d6"] and ledger.cursor("nct") == "d6" and ledger.cursor("other") is None
    table = ledger.table("nct", NOW)
    assert [(r["occurrence"], r["status"]) for r in table.orderBy("started").collect()] == list(zip("1234567", ["succeeded", "failed", "failed", "succeeded", "succeeded", "succeeded", "failed"]))
    assert [tuple(r) for r in ingestion.failures_in_a_row(table).collect()] == [("nct", 1)]
    assert ingestion.run_once(ledger, "new", "1", collect(0, "d"), now, known.limit(0)).status == "succeeded"


def land(folder, number, records, token):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.part", "w") as f:
        json.dump({"studies": [{"id": x, "名": "é"} for x in records], "nextPageToken": token}, f)
    os.rename(f"{folder}/.part", f"{folder}/page-{number:05d}.json")


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_pages_as_a_table_stop_at_a_gap(spark, tmp_path, scheme):
    folder = f"{tmp_path}/pages"
    assert landed.read_pages(spark, scheme + folder).count() == 0
    for n, ids in ((1, [1, 2]), (2, []), (3, [3]), (5, [5])):
        land(folder, n, ids, f"t{n}")
    got = [(r["page"], r["nth"], r["next_token"], json.loads(r["record"])) for r in landed.read_pages(spark, scheme + folder).orderBy("page", "nth").collect()]
    assert got == [(1, 0, "t1", {"id": 1, "名": "é"}), (1, 1, "t1", {"id": 2, "名": "é"}), (3, 0, "t3", {"id": 3, "名": "é"})]


def test_stream_of_pages_goes_on_where_it_ended(spark, tmp_path):
    folder, out, checkpoint = (f"{tmp_path}/{x}" for x in ("pages", "out", "check"))

    def run():
        stream = landed.stream_pages(spark, folder)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        query.processAllAvailable()
        query.stop()
        return sorted((r["page"], json.loads(r["record"])["id"]) for r in spark.read.schema(landed.SCHEMA).parquet(out).collect())

    land(folder, 1, [1, 2], "a")
    land(folder, 3, [7], "c")
    assert run() == [(1, 1), (1, 2)]
    land(folder, 2, [3], "b")  # the gap closes
    assert run() == [(1, 1), (1, 2), (2, 3), (3, 7)]
    assert run() == [(1, 1), (1, 2), (2, 3), (3, 7)]
    land(folder, 4, [8], None)
    assert run()[-1] == (4, 8)


def test_a_page_that_is_no_page_is_named(spark, tmp_path):
    with open(f"{tmp_path}/page-1.json", "w") as f:
        f.write("<html>")
    with pytest.raises(Exception, match="page-1.json is no page"):
        landed.read_pages(spark, str(tmp_path)).collect()
