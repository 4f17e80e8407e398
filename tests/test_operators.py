"""Truth tables and invariants of the record operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import changes, components, glossary, interpret, intel, monitors, prefilter, quality, resolve, rules, scopes, severity, versions, writes


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).cast("string" if v is None or isinstance(v, str) else type(v).__name__.replace("float", "double")).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "bucket"),
    [
        ("Phase II", "Phase 2"),
        ("PHASE 1/PHASE 2", "Phase 1/2"),
        ("Phase 1 / 2", "Phase 1/2"),
        ("Phase II-III", "Phase 2/3"),
        ("Ⅱ期", "Phase 2"),
        ("3 期", "Phase 3"),
        ("", "N/A"),
        (None, "N/A"),
        ("Not Applicable", "N/A"),
        ("pilot", "Other"),
        ("Phase 1 - see protocol", "Phase 1"),
        ("Phase 1b", "Other"),
        ("phase 1 to 2, Ⅲ期", "Phase 1/2/3"),
        ("Phase 1/Phase 2/Phase 3", "Phase 1/2/3"),
        ("unknown", "N/A"),
        ("Ⅱ/Ⅲ", "Other"),
        ("phase iv", "Phase 4"),
    ],
)
def test_phase_bucket(spark, raw, bucket):
    assert one(spark, tx.phase_bucket(F.col("a")), a=raw) == bucket
    assert tx.phase_bucket_of(raw or "") == bucket


@pytest.mark.parametrize(
    ("old", "new", "differ"),
    [(None, "", False), ("a", "a ", False), ('{"b":1,"a":2}', '{"a":2, "b":1}', False), ("[1,2]", "[2,1]", True), ("a", "b", True), (None, "x", True)],
)
def test_values_differ(spark, old, new, differ):
    assert one(spark, changes.values_differ(F.col("a"), F.col("b")), a=old, b=new) is differ


def test_nested_comparison_by_field(spark, rows):
    data = [(1, 1, '["a","b"]', '["x"]'), (1, 2, '["b","a"]', "X."), (1, 3, '["b"]', "y")]
    df = spark.createDataFrame(data, "id long, v long, countries string, primary_endpoint string")
    found = changes.detect_changes(df, ["id"], ["v"], ["countries", "primary_endpoint"], carry=["v"], nested=True)
    assert rows(found.select("v", "field_name")) == [(3, "countries"), (3, "primary_endpoint")]


@pytest.mark.parametrize(
    ("field", "old", "new", "expected"),
    [
        ("status_id", "Recruiting", "Terminated", ("critical", "status_transition", 95.0)),
        ("status_id", "Recruiting", "Completed", ("important", "status_transition", 60.0)),
        ("enrollment", "100", "120", ("important", "numeric_increase", 63.0)),
        ("enrollment", "100", "119", ("normal", "numeric_increase", 30.0)),
        ("enrollment", "0", "5", ("important", "modified", 60.0)),
        ("enrollment", None, "5", ("important", "added", 60.0)),
        ("enrollment", "5", "", ("important", "removed", 60.0)),
        ("completion_date", "2024-01-01", "2024-02-01", ("important", "date_shift", 61.0)),
        ("countries", '["A"]', '["A","B"]', ("important", "list_item_added", 60.0)),
        ("countries", '["A","B"]', '["A"]', ("important", "list_item_removed", 60.0)),
        ("sponsors", '["A"]', '["A"]', ("critical", "modified", 93.0)),
        ("primary_endpoint", "", "x", ("critical", "added", 95.0)),
        ("last_updated_at_source", "a", "b", ("minor", "modified", 10.0)),
        ("unknown", "a", "", ("normal", "removed", 30.0)),
    ],
)
def test_classify_change(spark, field, old, new, expected):
    assert tuple(one(spark, severity.classify_change(F.col("f"), F.col("a"), F.col("b")), f=field, a=old, b=new)) == expected


def test_event_hash_ignores_old_value_and_key_order(spark):
    h = lambda v: one(spark, changes.event_hash([F.lit("s"), F.lit("t")], F.lit("f"), F.col("a")), a=v)
    assert h('{"a":1,"b":2}') == h('{"b":2, "a":1}') != h('{"a":2}')


def test_versions_latest_streaks_and_stubs(spark, rows):
    df = spark.createDataFrame([("k", 1, "a", True), ("k", 2, "a", True), ("k", 3, "b", False), ("k", 4, "b", True)], "k string, v long, s string, thin boolean")
    assert rows(versions.skip_unchanged(df, ["k"], ["v"], ["s"]).select("v")) == [(1,), (3,)]
    chain = versions.version_chain(df, ["k"], ["v"], "v")
    assert rows(chain.select("v", "version_number", "superseded_by", "is_latest")) == [(1, 1, 2, False), (2, 2, 3, False), (3, 3, 4, False), (4, 4, None, True)]
    assert rows(changes.downgraded(df, ["k"], ["v"], F.col("thin")).select("v")) == [(1,), (2,), (3,)]
    assert [r["streak"] for r in versions.failure_streaks(df, ["k"], ["v"], F.col("thin")).orderBy("v").collect()] == [1, 2, 0, 1]
    restored = writes.restore_full_versions(df, ["k"], ["v"], F.col("thin"), "v")
    assert restored.filter("is_latest").first()["v"] == 3


def test_rules(spark, rows):
    df = spark.createDataFrame([(1, "Heart CAR-T", "Phase 1/Phase 2", '["China"]'), (2, None, "pilot", '["中国"]'), (3, "heart", None, '["France"]')], "id long, title string, phase string, countries string")
    columns = {"query": ["title"], "phase": "phase", "country": "countries", "registries": "title", "statuses": "title", "study_types": "title", "sponsor": "title", "condition": "title", "intervention": "title"}
    ids = lambda r: [x[0] for x in rows(rules.search(df, r, columns).select("id"))]
    assert ids({"query": "car-t heart"}) == [1]
    assert ids({"country": "china"}) == [1, 2]
    assert ids({"phase": ["Phase 1/2"]}) == [1]
    assert ids({"phase": "phase 2"}) == [1]
    assert ids({"phase": "other"}) == [2]
    assert ids({"phase": "N/A"}) == [3]
    assert ids({}) == [1, 2, 3]
    for bad in ({"nope": "x"}, {"country": ["x"] * 21}, {"country": "x" * 201}, {"query": 3}):
        with pytest.raises(ValueError):
            rules.validate_rules(bad)


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        ("recruiting phase 2 trials in China for myocarditis on NCT", {"registries": ["NCT"], "statuses": ["Recruiting"], "phase": ["Phase 2"], "country": ["China"], "query": ["myocarditis"]}),
        ("phase II or III", {"phase": ["Phase 2", "Phase 3"]}),
        ("Phase 1 / 2 lupus", {"phase": ["Phase 1/Phase 2"], "query": ["lupus"]}),
        ("中国正在招募的II期心肌炎临床试验", {"query": ["心肌炎"], "country": ["China"], "statuses": ["Recruiting"], "phase": ["Phase 2"]}),
        ("ChiCTR 心肌炎试验", {"query": ["心肌炎"], "registries": ["ChiCTR"]}),
        ("Phase 3 heart failure studies sponsored by Novartis", {"query": ["heart failure"], "phase": ["Phase 3"], "sponsor": ["Novartis"]}),
        ("Observational troponin studies in the United States", {"query": ["troponin"], "study_types": ["Observational"], "country": ["United States"]}),
        ("intervention: CAR-T trials", {"intervention": ["CAR-T"]}),
        ("ClinicalTrials.gov CAR-T myocarditis trials", {"query": ["CAR-T myocarditis"], "registries": ["NCT"]}),
        ("EudraCT 5-FU trials", {"query": ["5-FU"], "registries": ["EUCTR"]}),
        ("active, not recruiting asthma", {"statuses": ["Active, not recruiting"], "query": ["asthma"]}),
        ("a mediator of China syndrome", {"query": ["a mediator China syndrome"]}),
    ],
)
def test_interpret(text, rule):
    got = interpret.interpret(text)
    assert got["rule"] == rule and got["confidence"] == "high"
    assert interpret.validate_proposal(got["rule"]) == rule


@pytest.mark.parametrize(
    ("text", "unclear", "unsupported", "rule"),
    [
        ("recent myocarditis trials", ["recent"], [], {"query": ["myocarditis"]}),
        ("most promising myocarditis trials", [], ["promising"], {"query": ["myocarditis"]}),
        ("myocarditis trials updated in the last 6 months", [], ["update window"], {"query": ["myocarditis"]}),
        ("active myocarditis since May 2024 in Europe", ["active"], ["update window", "Europe"], {"query": ["myocarditis"]}),
        ("Chinese registry asthma", ["Chinese registry"], [], {"query": ["asthma"]}),
        ("自2024年5月以来 哮喘", [], ["update window"], {"query": ["哮喘"]}),
        ("最近一个月 哮喘 成功率高", [], ["update window", "likely to succeed"], {"query": ["哮喘"]}),
        (
            "过去半年中国开展的、仍在招募的 II/III 期心肌炎药物干预试验",
            [],
            ["update window"],
            {"country": ["China"], "statuses": ["Recruiting"], "phase": ["Phase 2", "Phase 3"], "query": ["心肌炎"], "study_types": ["Interventional"]},
        ),
    ],
)
def test_interpret_names_what_it_cannot_say(text, unclear, unsupported, rule):
    got = interpret.interpret(text)
    assert (got["ambiguities"], got["unsupported"], got["rule"], got["confidence"]) == (unclear, unsupported, rule, "low")


def test_proposals_are_checked():
    for bad in (" ", "x" * 501, 3):
        with pytest.raises(ValueError):
            interpret.interpret(bad)
    for bad in ({"registries": ["Fake"]}, {"statuses": ["Active"]}, {"phase": ["Phase 8"]}, {"updated_since": ["today"]}, {"query": "x"}, {"country": [42]}, {"query": []}):
        with pytest.raises(ValueError):
            interpret.validate_proposal(bad)


def test_keywords_and_cleaning(spark):
    assert one(spark, tx.keyword_matches(F.col("a"), "CAR-T"), a="new car-t cells")
    assert not one(spark, tx.keyword_matches(F.col("a"), "art"), a="heart")
    assert one(spark, tx.keyword_matches(F.col("a"), "心肌"), a="急性心肌炎")
    assert one(spark, tx.clean_markup(F.col("a")), a="a<br/>b<b>c</b>\n\n\n\nd") == "a\nbc\n\nd"
    assert one(spark, tx.unescape_markup(F.col("a")), a="&amp;lt;b") == "<b"
    assert one(spark, tx.list_items(F.col("a")), a='[{"name":"x"},"y;z","x"]') == ["x", "y", "z"]
    assert one(spark, tx.to_json_array(F.col("a")), a=" a \n\n b") == '["a","b"]'
    assert one(spark, tx.to_json_array(F.col("a")), a=" \n ") is None
    assert str(one(spark, tx.iso_date(F.col("a")), a="05/11/2024")) == "2024-11-05"
    assert str(one(spark, tx.iso_date(F.col("a")), a="2024年3月5日")) == "2024-03-05"
    assert one(spark, tx.iso_date(F.col("a")), a="2024") is None
    assert str(one(spark, tx.iso_date(F.col("a"), True), a="2024")) == "2024-01-01"
    assert one(spark, tx.labelled_sum(F.col("a")), a="样本量:30;样本量:12") == 42
    assert one(spark, tx.first_integer(F.col("a")), a="about 1,200 people") == 1200
    parts = one(spark, tx.eligibility_parts(F.col("a")), a="Inclusion Criteria:\nadult\nExclusion Criteria:\nchild")
    assert (parts["inclusion"], parts["exclusion"]) == ("adult", "child")
    assert one(spark, tx.criteria_items(F.col("a")), a="1. one\n2. two\n- one") == ["one", "two"]
    buckets = {"Not yet recruiting": "other", "Active,  not recruiting": "other", "招募完成": "other", "未开始招募": "other", "Recruiting": "recruiting", "正在招募": "recruiting", "Completed": "completed", "已完成": "completed", "Terminated": "terminated", "Suspended": "other", "open": "other", None: "other"}
    for label, bucket in buckets.items():
        assert one(spark, tx.status_bucket(F.col("a")), a=label) == bucket, label
    assert tx.merge_queries(["a OR b c", "B C OR d"]) == 'a OR "b c" OR d'


def test_scopes_and_windows(spark, rows):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, None)], "id long, k long")
    keys = lambda *v: spark.createDataFrame([(x,) for x in v], "k long")
    assert rows(scopes.in_scope(df, "k", [keys(10, 20), keys(20)]).select("id")) == [(1,), (2,)]
    ids = spark.createDataFrame([(3,)], "id2 long")
    either = scopes.in_either_scope(df.withColumn("id2", F.col("id")), {"k": [keys(10)], "id2": [ids]}, "id")
    assert rows(either.select("id")) == [(1,), (3,)]
    assert rows(scopes.outside(df, keys(10), "k").select("id")) == [(2,), (3,), (4,)]
    assert scopes.window_bounds("24h", "2024-01-31 00:00:00") == ("2024-01-30 00:00:00", "2024-01-31 00:00:01")
    with pytest.raises(ValueError):
        scopes.window_bounds("custom", "2024-01-31", "2022-01-01", "2024-01-01")


def test_components_any_shape(spark, rows):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (5, 5), (20, 21), (21, 20), (None, 1)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 240)]
    found = dict(rows(components.connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert found[4] == 1 and found[10] == 8 and found[21] == 20 and found[159] == 100 and found[240] == 200
    assert 5 not in found


def test_bitmap_never_misses(spark):
    keys = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("h"))
    marked = prefilter.KeyBitmap(keys, F.col("h")).mark(spark.range(0, 5000).withColumn("h", F.xxhash64("id")), F.col("h"))
    hits = {r["id"] for r in marked.filter("maybe").collect()}
    assert set(range(0, 5000, 7)) <= hits and len(hits) < 2500


def test_membership_schedule_outbox(spark, rows):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    assert rows(monitors.membership_diff(ids(1, 2), ids(2, 3, 4), "id", ever=ids(1, 2, 4))) == [(1, "left"), (2, "stayed"), (3, "entered"), (4, "reentered")]
    assert monitors.run_monitor(None, ids(1), "id", ids(1), "id", None).count() == 0
    a = datetime(2024, 1, 1)
    assert monitors.next_due(a, timedelta(days=1), a + timedelta(days=3)) == a + timedelta(days=4)
    assert monitors.next_due(a, timedelta(days=1), a - timedelta(hours=1)) == a
    base = spark.createDataFrame([(1, "x"), (2, "y")], "id long, s string")
    now = spark.createDataFrame([(1, "x"), (2, "z"), (3, "n")], "id long, s string")
    assert rows(monitors.baseline_diff(base, now, "id", "s")) == [(1, "unchanged"), (2, "changed"), (3, "new")]
    assert rows(monitors.report_rows(now, base, "id", "s", "incremental").select("id")) == [(2,), (3,)]
    assert monitors.advanced_watermark(ids(5, 9), "id", 7, True) == 9
    assert monitors.advanced_watermark(ids(5, 9), "id", 7, False) == 7


def test_writes_are_idempotent(spark, rows):
    new = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, "c", 3)], "k long, v string, o long")
    first = writes.insert_ignore(new.limit(0), new, ["k"], ["o"])
    assert rows(first) == [(1, "a", 1), (2, "c", 3)]
    assert writes.insert_ignore(first, new, ["k"], ["o"]).count() == 0
    assert rows(writes.upsert(first, new, ["k"], ["o"])) == [(1, "b", 2), (2, "c", 3)]


def test_identifiers_and_entities(spark, rows):
    data = [(1, "NCT00000001", '{"secondary":"EU 2019-000001-12"}'), (2, "2019-000001-12", "see NCT00000001"), (3, "ChiCTR2600131888", "none"), (4, "X", "ABC-123X, x")]
    ids = resolve.extract_identifiers(spark.createDataFrame(data, "record long, own string, payload string"), "record", "own", "payload", "$.secondary")
    found = {(r["record"], r["type"], r["value"]): r["confidence"] for r in ids.collect()}
    assert found[(1, "NCT", "NCT00000001")] == 1.0 and found[(1, "EudraCT", "2019-000001-12")] == 0.95
    assert (3, "CTR", "CTR26001318") not in found and found[(4, "ProtocolNumber", "ABC-123X")] == 0.6
    assert rows(resolve.resolve_entities(ids, "record")) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert resolve.review_queue(ids, resolve.resolve_entities(ids, "record"), "record").count() == 0


def test_trigram_candidates_equal_brute_force(spark, rows):
    titles = ["heart failure in adults", "heart failure in adult", "lung cancer", "cancer of the lung", "", None, "heart failure"]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, t string")
    grams = [{(t or "").lower()[i : i + 3] for i in range(len(t or "") - 2)} for t in titles]
    want = [(a, b, len(grams[a] & grams[b])) for a in range(len(titles)) for b in range(a) if len(grams[a] & grams[b]) >= 6]
    assert rows(resolve.trigram_candidates(df, "id", "t", 6)) == sorted(want, key=str)
    assert rows(resolve.similar_titles(df, "id", "t", 0.9, 6).select("a", "b")) == [(1, 0)]


def test_similar_titles_miss_no_pair(spark, rows):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    head = "a study of the same opening words for all the "
    titles = [head + f"{i:03d}" for i in range(230)] + ["ab", "abc", "abcd", "abce", "Copy", "copy", "copy", "", "", None]
    titles += ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 14))) for _ in range(120)]
    low = {}
    for i, t in enumerate(titles):
        if t is not None:
            low.setdefault(t.lower(), []).append(i)
    ratio = lambda x, y: max(SequenceMatcher(None, x, y).ratio(), SequenceMatcher(None, y, x).ratio())
    df = spark.createDataFrame(list(enumerate(titles)), "id long, t string")
    for least in (0.85, 0.6):
        want = {(i, ids[0]) for ids in low.values() for i in ids[1:]}
        want |= {(max(i[0], j[0]), min(i[0], j[0])) for x, i in low.items() for y, j in low.items() if x < y and ratio(x, y) >= least}
        got = [tuple(r) for r in resolve.similar_titles(df, "id", "t", least).select("a", "b").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        assert sum(b < 230 for a, b in got if a == 229) == 229  # more partners than 200


def test_review_decisions(spark, rows):
    queue = spark.createDataFrame([(1, "pending"), (2, "approved"), (3, "pending")], "id long, state string")
    said = spark.createDataFrame([(1, "approve"), (2, "reject")], "id long, decision string")
    assert rows(resolve.decide(queue, said, ["id"])) == [(1, "approved"), (2, "rejected"), (3, "pending")]


def test_glossary(spark, rows):
    docs = spark.createDataFrame([(1, "Acute myocarditis of heart"), (2, "acute myocarditis"), (3, "acute acute")], "id long, t string")
    mined = dict(rows(glossary.mine_phrases(docs, "id", F.col("t"))))
    assert mined == {"acute": 3, "myocarditis": 2, "acute myocarditis": 2}
    assert glossary.segment("心肌炎治疗", ["心肌炎", "心肌", "治疗"]) == ["心肌炎", "治疗"]
    assert glossary.segment("心肌炎x", ["心肌炎"]) is None
    assert glossary.lookup({"心肌炎": "myocarditis"}, "Myocarditis") == "心肌炎"
    learned = glossary.learn(spark.createDataFrame([("a", "b", 1)], "zh_term string, en_term string, evidence long"), spark.createDataFrame([("a", "b", 1)], "zh_term string, en_term string, evidence long"))
    assert rows(learned) == [("a", "b", 2, "active")]
    lists = spark.createDataFrame([(["急性心肌炎研究", "慢性心肌炎"],), (["ab", "cd"],)], "x array<string>")
    assert rows(lists.select(glossary.common_substring("x"))) == [("性心肌炎",), (None,)]


def test_quality(spark, rows):
    df = spark.createDataFrame([("a", " - ", 1), ("a", "x", 1), ("b", None, 2), ("b", "[]", 2)], "s string, f string, k long")
    assert rows(quality.coverage_matrix(df, [F.col("s")], {"f": F.col("f")})) == [("a", 2, 1), ("b", 2, 0)]
    checks = quality.audit([quality.broken_rule(df, F.col("k") > 1, "k", "warning"), quality.broken_rule(df, F.col("k") > 9, "z")])
    assert quality.audit_status(checks).first()["status"] == "warning"
    assert rows(quality.confidence_histogram(spark.createDataFrame([(0.7,), (0.69,), (0.9,)], "v double"), F.col("v"), [0.7, 0.8, 0.9])) == [("0.70-0.80", 1), ("<0.70", 1), (">=0.90", 1)]


def test_freshness_boundaries(spark, rows):
    df = spark.createDataFrame([("a", "2024-01-30 17:00:00"), ("b", "2024-01-30 16:59:59"), ("c", "2024-01-30 00:00:00"), ("d", None)], "s string, t string")
    got = intel.freshness(df, "s", "t", "2024-01-31 00:00:00", F.lit(1.0) * 8).select("s", "state")
    assert rows(got) == [("a", "fresh"), ("b", "fresh"), ("c", "delayed"), ("d", "unknown")]


def test_record_operators(spark, rows):
    from palimpsest.operators import records

    assert tuple(one(spark, records.id_origin(F.col("a")), a="nct123")) == ("ClinicalTrials.gov", "United States")
    assert one(spark, records.native_or_mirror(F.lit("ICTRP"), F.col("a"), "ICTRP", "ChiCTR"), a="ChiCTR1") == "ICTRP_ChiCTR"
    got = one(spark, records.sites(F.col("a")), a="Clinic, Paris, France; Lab")
    assert [tuple(s) for s in got] == [("Clinic", "Paris", "France"), ("Lab", None, None)]
    assert one(spark, records.investigator(F.col("a")), a='{"officials":[{"name":"A","role":"CHAIR"},{"name":"B","role":"PRINCIPAL_INVESTIGATOR"}]}') == "B"
    assert one(spark, records.wrap_legacy_list(F.col("a")), a="x; y") == '["x","y"]'
    assert one(spark, records.wrap_legacy_list(F.col("a")), a='["x"]') == '["x"]'
    assert one(spark, records.numbered_rows(F.col("a")), a="1\nA\nb\n2\nC\n") == [["A", "b"], ["C"]]
    assert one(spark, records.translate_terms(F.col("a"), {"heart": "h", "heart failure": "hf"}), a="heart failure, heart") == "hf, h"
    assert records.query_intent("Acme Pharma") == "sponsor" and records.query_intent("myocarditis") == "condition" and records.query_intent("car-t") == "text"
    pages = spark.createDataFrame([("w", 1, "a"), ("w", 2, "k1"), ("w", 3, "k2"), ("w", 4, "b")], "w string, p long, id string")
    known = spark.createDataFrame([("k1",), ("k2",)], "id string")
    assert rows(records.seen_pages(pages, known, "w", "p", "id").select("p")) == [(1,), (2,), (3,)]
    texts = spark.createDataFrame([(1, "Heart failure"), (2, "lung"), (3, None)], "id long, t string")
    post = records.trigram_postings(texts, "id", F.col("t"))
    for phrase in ("heart", "rt f", "ng", "zzz"):
        scan = texts.filter(F.lower("t").contains(phrase))
        assert rows(records.trigram_search(texts, post, "id", F.col("t"), phrase)) == rows(scan)
    runs = spark.createDataFrame([("r", "running", "c0", None)], "run_id string, status string, cursor_before string, cursor_after string")
    assert records.finish_run(runs, "r", True, "c1").first()["cursor_after"] == "c1"
    assert records.finish_run(runs, "r", False, "c1").first()["cursor_after"] == "c0"
    assert rows(records.mixed_language_pairs(spark.createDataFrame([("g", 1, "心"), ("g", 2, "x"), ("h", 3, "y")], "g string, k long, t string"), "g", "k", "t")) == [("g", 1, 2)]


def test_false_merges_by_id_prefix_alone(spark, rows):
    data = [(1, "NCT1", "a"), (1, "CTR1", "a"), (2, "NCT2", "a"), (2, "NCT3", "a"), (3, "NCT4", "a"), (3, "NCT5", "b"), (4, "NCT6", "a"), (5, None, "a"), (5, "NCT7", None)]
    df = spark.createDataFrame(data, "master long, id string, phase string")
    assert rows(quality.false_merges(df, "master", ["phase"], "id")) == [(1, 2, 1, 2), (3, 2, 2, 1)]
    assert rows(quality.false_merges(df, "master", [], "id").select("master")) == [(1,)]


def test_false_merges_shuffle_rows_once_per_kind(spark, rows):
    data = [(1, "P1", 1.0, "NCT1"), (1, "P1", 1.0, "NCT2"), (1, None, 2.0, "CTR3"), (2, "P1", 0.0, "NCT4"), (2, "P1", -0.0, "NCT5"), (3, "P1", None, "NCT6"), (3, "P2", None, "NCT7"), (None, "P1", 1.0, "A1"), (None, "P2", 1.0, "A2")]
    df = quality.false_merges(spark.createDataFrame(data, "master long, phase string, size double, id string"), "master", ["phase", "size"], "id")
    assert rows(df.select("master", "n_records", "n_phase", "n_size", "n_prefixes")) == [(1, 3, 1, 2, 2), (3, 2, 2, 0, 1), (None, 2, 2, 1, 1)]
    # no row per distinct count goes through a shuffle
    assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
