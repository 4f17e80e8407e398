"""Queries that cover whole tables, on small tables with rows that the samples leave out."""

import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import glossary
from palimpsest.operators.glossary import STOP_WORDS
from palimpsest.plans import registry

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    texts = ["Api-Key: abc rest", "my PASSWORD = x1", "token=zz", "plain rare words here", "plain rare words there", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{top}/documents.parquet")
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    events = [(0, day(2), 1, "a", 1.0), (1, day(12), 1, "b", 2.0), (2, day(17), 1, "b", 3.0), (3, day(7), 2, "a", 4.0), (4, day(20), 2, "a", 5.0), (5, day(20), 2, "c", 6.0), (6, day(12), 3, "a", 7.0)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{top}/events.parquet")
    spark.range(1, 30001).filter("id NOT IN (7, 25000)").select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{top}/orders.parquet")
    return top


@pytest.mark.parametrize(("name", "n"), [("redacted_documents", 7), ("insert_ignore_all", 1), ("upsert_all", 3), ("id_gaps", 2)])
def test_whole_table_equals_sql(spark, sf, name, n):
    con = duckdb.connect()
    for t in ("documents", "events", "orders"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, sf)
    got = sorted(str(tuple(r)) for r in df.collect())
    assert got == sorted(str(r) for r in con.execute(f"select {', '.join(df.columns)} from ({registry.oracle_sql()[name]})").fetchall()) and len(got) == n


def test_whole_table_values(spark, sf, rows):
    q = registry.queries()
    texts = dict(rows(q["redacted_documents"](spark, sf)))
    assert (texts[0], texts[1], texts[2]) == ("Api-Key: *** rest", "my PASSWORD = ***", "token=***")
    assert rows(q["upsert_all"](spark, sf).select("user_id", "event_id")) == [(1, 2), (2, 5), (3, 6)]
    assert rows(q["insert_ignore_all"](spark, sf)) == [(2, "c", 5)]
    assert rows(q["id_gaps"](spark, sf)) == [(25000,), (7,)]


def test_phrase_mining_equals_brute_force(spark, sf):
    counts = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = (r["text"] or "").lower().replace(":", "").split()
        grams = {tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1)}
        for g in grams:
            if not set(g) & set(STOP_WORDS) and 3 <= len(" ".join(g)) <= 60:
                counts[" ".join(g)] = counts.get(" ".join(g), 0) + 1
    want = {k: n for k, n in counts.items() if n >= 2}
    got = {r["phrase"]: r["n_texts"] for r in registry.queries()["phrase_mining"](spark, sf).collect()}
    assert got == want and {"plain rare words", "rare"} <= set(got)


def test_mined_phrases_count_keys_once(spark, monkeypatch):
    monkeypatch.setattr(glossary, "BUCKET_CHARS", 900)
    r = random.Random(3)
    words = ["heart", "lung", "of", "a", "x", "Trial.", "(phase", "äther", "y" * 31, "z" * 29, "...", "x" * 58]
    rows = [(r.choice([None, 0, 1, 2, *range(3, 60)]), r.choice([None, "", *(" ".join(r.choice(words) for _ in range(r.randrange(1, 30))) for _ in range(8))])) for _ in range(90)]
    once = [(i, t) for i, (_, t) in enumerate(rows)]
    for table in (rows, once):
        df = spark.createDataFrame(table, "k long, t string").repartition(3)
        for low, high, least in ((1, 4, 2), (2, 2, 1), (3, 3, 3)):
            counts = {}
            for k, t in table:
                w = [x for x in (w.strip(".,;:()[]/\"'") for w in (t or "").lower().split()) if x]
                for g in {tuple(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)}:
                    if k is not None and not set(g) & set(STOP_WORDS) and 3 <= len(" ".join(g)) <= 60:
                        counts.setdefault(" ".join(g), set()).add(k)
            want = {p: len(ks) for p, ks in counts.items() if len(ks) >= least}
            got = glossary.mine_phrases(df, "k", F.col("t"), low, high, least=least).collect()
            assert {x["phrase"]: x["n_texts"] for x in got} == want and len(got) == len(want) > 3


def test_slices_count_a_phrase_once(spark):
    lists = pa.array([["aaa", "bbb"] * 20, None, [], ["aaa", "bbb", "ccc"], ["bbb", "aaa"]], pa.list_(pa.string()))
    found = {p: n for phrases, counts, _ in glossary._count_grams(lists, 1, 2, ("ccc",), 60) for p, n in zip(phrases.to_pylist(), counts.to_pylist())}
    assert found == {"aaa": 3, "bbb": 3, "aaa bbb": 2, "bbb aaa": 2}
    many = pa.array([["w"] * 900_000] * 6, pa.list_(pa.string()))
    assert [len(x) for x in glossary._slices_of_words(many)] == [2, 2, 2]
