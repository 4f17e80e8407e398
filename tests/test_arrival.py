"""Resolution in order of arrival against a plain sequential loop."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import arrival
from palimpsest.operators.resolve import AUTO, REGISTRY_TYPES


def plain(records, identifiers, titles=()):
    """One record at a time, all state in tables that are searched anew."""
    mapped, out = [], {}
    mine = {}
    for r, kind, value, confidence, nth in sorted((x for x in identifiers if None not in x[:3]), key=lambda x: (x[4], x[1], x[2])):
        if all((kind, value) != (a, b) for a, b, _ in mine.setdefault(r, [])):
            mine[r].append((kind, value, confidence))
    for r, _, aggregator in sorted(records, key=lambda x: (x[1], x[0])):
        matches = []
        for kind, value, confidence in mine.get(r, []):
            for other, master in mapped:
                if any((kind, value) == (a, b) for a, b, _ in mine.get(other, [])) and master not in [m[2] for m in matches]:
                    matches.append((0 if kind in REGISTRY_TYPES or confidence >= AUTO else 1, -confidence, master, f"identifier_match {kind}"))
        if all(m[0] for m in matches):
            near = {}
            for a, b, ratio in titles:
                other = b if a == r else a if b == r else None
                for known, master in mapped:
                    if known == other and master not in [m[2] for m in matches]:
                        near[master] = max(ratio, near.get(master, 0))
            matches += [(1, -round(near[m], 4), m, "title_similarity") for m in sorted(near)]
        matches.sort(key=lambda m: m[:2])
        if matches and matches[0][0]:
            out[r] = ("queued", matches[0][2], matches[0][3], -matches[0][1])
        elif matches:
            mapped.append((r, matches[0][2]))
            out[r] = ("linked", matches[0][2], matches[0][3], -matches[0][1])
        else:
            mapped.append((r, r))
            out[r] = ("created_via_aggregator" if aggregator else "created", r, "first_record", 1.0)
    return out


def cases(seed, n=150):
    r = random.Random(seed)
    records = [(i, r.randrange(40), r.random() < 0.3) for i in range(n)]
    identifiers = []
    for i in range(n):
        for nth in range(r.randrange(4)):
            kind = r.choice(["NCT", "ProtocolNumber", "ProtocolNumber", "CTR"])
            identifiers.append((i, kind, f"{kind}{r.randrange(40 if kind != 'ProtocolNumber' else 25)}", r.choice([0.6, 0.7, 0.8, 0.95]), nth))
    titles = [(a, b, r.choice([0.9, 0.93, 0.99, 0.99])) for a, b in {(r.randrange(n), r.randrange(n)) for _ in range(30)} if a != b]
    return records, identifiers, titles


def test_equals_the_sequential_loop(spark):
    seen = set()
    for seed in range(3):
        records, identifiers, titles = cases(seed)
        identifiers += [(0, None, "x", 1.0, 9), (3, "NCT", None, 1.0, 9)]
        rec = spark.createDataFrame(records, "rid long, at int, aggregator boolean").withColumn("part", F.lit("own"))
        ids = spark.createDataFrame(identifiers, "rid long, type string, value string, confidence double, nth int")
        for pairs in (None, titles):
            near = None if pairs is None else spark.createDataFrame(pairs, "a long, b long, ratio double")
            got = arrival.resolve_in_order(rec.repartition(3), ids, "rid", ["at"], "aggregator", near).collect()
            want = plain(records, identifiers, pairs or ())
            assert {x["record"]: (x["action"], x["master"], x["method"], x["confidence"]) for x in got} == want and len(got) == len(records)
            seen |= {x[0] for x in want.values()} | {x[2] for x in want.values()}
    assert {"linked", "queued", "created", "created_via_aggregator", "title_similarity", "first_record"} <= seen


def test_order_decides_and_empty_tables(spark):
    ids = spark.createDataFrame([(1, "ProtocolNumber", "A-1", 0.6, 0), (2, "ProtocolNumber", "A-1", 0.6, 0), (2, "NCT", "N", 1.0, 1), (3, "NCT", "N", 1.0, 0)], "rid long, type string, value string, confidence double, nth int")
    rec = lambda order: spark.createDataFrame([(r, k) for k, r in enumerate(order)], "rid long, at int")
    run = lambda order: {x["record"]: (x["action"], x["master"]) for x in arrival.resolve_in_order(rec(order), ids, "rid", ["at"]).collect()}
    # a queued record maps nothing: what shares its number only starts anew
    assert run([1, 2, 3]) == {1: ("created", 1), 2: ("queued", 1), 3: ("created", 3)}
    assert run([3, 2, 1]) == {3: ("created", 3), 2: ("linked", 3), 1: ("queued", 3)}
    assert arrival.resolve_in_order(rec([1]).limit(0), ids.limit(0), "rid", ["at"]).count() == 0
    counts = {r["action"]: r["n"] for r in arrival.outcome_counts(arrival.resolve_in_order(rec([3, 2, 1]), ids, "rid", ["at"])).collect()}
    assert counts == {"created": 1, "linked": 1, "queued": 1}


def test_one_identifier_of_very_many_records(spark):
    n = 20_000
    rec = spark.range(n).withColumnRenamed("id", "rid").withColumn("at", -F.col("rid"))
    ids = rec.select("rid", F.lit("NCT").alias("type"), F.lit("same").alias("value"), F.lit(1.0).alias("confidence"), F.lit(0).alias("nth"))
    got = arrival.resolve_in_order(rec, ids, "rid", ["at"])
    assert got.groupBy("action", "master").count().collect() and {(r["action"], r["master"], r["count"]) for r in got.groupBy("action", "master").count().collect()} == {("created", n - 1, 1), ("linked", n - 1, n - 1)}
