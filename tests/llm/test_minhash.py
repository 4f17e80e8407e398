"""Near-duplicates against brute force on full sets."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import minhash, set_links


def brute(docs, percent=85):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = find(x), find(y)
                up[max(a, b)] = min(a, b)
    return {i: (sorted(len(s) for s in sets[i]), find(i)) for i in ids}


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(5000)
    docs = []
    for _ in range(12):
        base = [word() for _ in range(r.randrange(3, 150))]
        for _ in range(r.randrange(1, 14)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                copy[r.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    hub = [word() for _ in range(120)]
    for _ in range(60):  # a near group whose members mostly differ from each other
        copy = list(hub)
        for _ in range(r.randrange(0, 7)):
            copy[r.randrange(len(copy))] = word()
        docs.append(" ".join(copy))
    docs += [None, "", "  \n", "one two", "ONE  two", "one two three", "long " * 3000]
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block", [4096, 16])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(set_links, "KEY_BLOCK", block)
    monkeypatch.setattr(set_links, "FAMILY_BLOCK", block)
    docs = corpus()
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute(docs)
    assert {r["doc_id"]: ([r["n_shingles"]], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_family_of_five_thousand(spark, monkeypatch):
    """Near copies of one text, all of them linked, and a second group that shares keys but no link."""
    monkeypatch.setattr(set_links, "FAMILY_BLOCK", 64)
    r = random.Random(8)
    base = ["w%d" % i for i in range(160)]
    docs = []
    for i in range(5000):
        copy = list(base)
        copy[r.randrange(160)] = "x%d" % i
        docs.append(" ".join(copy))
    cousin = base[:124] + ["c%d" % i for i in range(36)]
    docs += [" ".join(cousin[:-1] + [f"last{i}"]) for i in range(30)]
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(8)).collect()
    component = {x["doc_id"]: x["component_id"] for x in got}
    assert {component[i] for i in range(5000)} == {0} and {component[i] for i in range(5000, 5030)} == {5000}


def test_two_loose_families_in_blocks(spark, monkeypatch):
    """Chains whose ends are far apart: representatives miss some links, the rest must find them."""
    monkeypatch.setattr(set_links, "KEY_BLOCK", 8)
    monkeypatch.setattr(set_links, "FAMILY_BLOCK", 5)
    r = random.Random(9)
    docs = []
    for f in range(4):
        text = ["f%d_%d" % (f, i) for i in range(120)]
        for i in range(40):
            text = list(text)
            text[r.randrange(120)] = "n%d_%d" % (f, i)
            docs.append(" ".join(text))
    docs = list(enumerate(docs))
    r.shuffle(docs)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: ([r["n_shingles"]], r["component_id"]) for r in got} == brute(docs)


def test_repeated_null_and_clashing_rows(spark):
    docs = [(1, "a b c d e f"), (1, "x y z u v w"), (2, "X Y Z U V W"), (None, "a b c d e f"), (3, "a b c d e f"), (4, None), (4, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"node": F.lit("n"), "kept": F.lit(7), "n": F.lit(0)})
    got = {(r["doc_id"], r["component_id"], r["kept"], r["repeated"]) for r in minhash.near_duplicates(df).collect()}
    assert got == {(1, 1, True, True), (2, 1, False, False), (3, 1, False, False), (None, None, True, False), (4, 4, True, True)}
    kept = sorted((str(r["doc_id"]), r["text"]) for r in minhash.keep_one(df).collect())
    assert kept == [("1", "a b c d e f"), ("4", None), ("None", "a b c d e f")]
    assert minhash.keep_one(df).columns == df.columns


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0


def test_bounds():
    assert minhash.miss_probability(0.85) < 1e-6
    assert 30 < minhash.fine_bound(0.85) < 60
