"""Three-word shingles at similarity 0.9 against brute force on full sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import ngram_join, set_links


def brute(docs, percent=90):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset())
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
    word = lambda: "w%d" % r.randrange(r.choice([40, 4000]))
    passage = [word() for _ in range(60)]
    docs = []
    for _ in range(14):
        base = [word() for _ in range(r.randrange(3, 260))]
        if r.random() < 0.5:
            base[len(base) // 2 :] += passage
        for _ in range(r.randrange(1, 12)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[r.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    hub = [word() for _ in range(150)]
    for _ in range(50):  # near the border
        copy = list(hub)
        for _ in range(r.randrange(0, 5)):
            copy[r.randrange(len(copy))] = word()
        docs.append(" ".join(copy))
    docs += [None, "", "  \n", "one two", "ONE  two", "one two three", "one two\x1cthree", "long " * 3000, "é é É é é é é É"]
    # exactly at the threshold and just below it: 18 of 20, 17 of 19
    docs += [" ".join(f"t{i}" for i in range(20)), " ".join(f"t{i}" for i in range(21)), " ".join(f"t{i}" for i in range(2, 22)), " ".join(f"t{i}" for i in range(22))]
    r.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("block,least,window", [(4096, 16, 2_000_000), (16, 2, 300)])
def test_equals_brute_force(spark, monkeypatch, block, least, window):
    monkeypatch.setattr(set_links, "KEY_BLOCK", block)
    monkeypatch.setattr(set_links, "FAMILY_BLOCK", block)
    monkeypatch.setattr(ngram_join, "WINDOW_TOKENS", window)
    monkeypatch.setattr(ngram_join, "FREQUENT", least)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("node", "key", "token", "times", "id", "n", "fine")})
    got = ngram_join.jaccard_classes(df.repartition(3)).collect()
    want = brute(docs)
    assert {r["doc_id"]: ([r["n_shingles"]], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) < len(docs) - 60


def test_repeated_and_null_ids(spark):
    docs = [(1, "a b c d e f"), (1, "x y z u v w"), (2, "X Y Z U V W"), (None, "a b c d e f"), (3, "a b c d e f"), (4, None), (4, None)]
    got = sorted(ngram_join.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect(), key=str)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(1, 4, 1), (1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 0, 4), (4, 0, 4)]
    assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(4, None)]
    assert ngram_join.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_no_filter_loses_a_link(seed):
    """Under any bitmap of frequent tokens, linked sets share a prefix token in every order and have close signatures."""
    r = np.random.default_rng(seed)
    bitmap = r.integers(0, 256, 1 << int(r.integers(0, 8)), dtype=np.uint8)
    rule, linked = ngram_join.OrderRule(90, bitmap if seed else None), 0
    for _ in range(400):
        n = int(r.integers(1, 400))
        one = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        gone, new = r.random(len(one)) < r.random() * 0.12, r.integers(0, 1 << 63, int(r.integers(0, 1 + n // 10))).astype(np.uint64)
        other = np.unique(np.concatenate([one[~gone], new]))
        if not len(other) or not rule.linked(set_links.common_members(one, other), len(one), len(other)):
            continue
        linked += 1
        assert rule.alike(len(one), len(other))
        assert rule.distances(rule.signature(one), rule.signature(other)[None])[0] <= rule.bound(len(one), len(other))
        assert all(set_links.common_members(rule.prefix(one, k), rule.prefix(other, k)) for k in range(ngram_join.ORDERS))
    assert linked > 50


def test_prefix_lengths_and_saturated_cells():
    rule = ngram_join.OrderRule(90)
    members = np.arange(1000, dtype=np.uint64)
    assert [len(rule.prefix(members[:n], 0)) for n in (1, 2, 10, 11, 1000)] == [1, 1, 2, 2, 101]
    assert rule.signature(members).view(np.uint8).tolist() == [255] + [0] * 127


def test_large_near_group(spark):
    """Two thousand near copies, each linked with most others, and a common passage in unlinked texts."""
    r = random.Random(4)
    base = ["w%d" % i for i in range(200)]
    docs = []
    for i in range(2000):
        copy = list(base)
        copy[r.randrange(200)] = "x%d" % i
        docs.append(" ".join(copy))
    docs += [" ".join([*base[:80], *["p%d_%d" % (i, k) for k in range(120)]]) for i in range(400)]
    got = ngram_join.jaccard_classes(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(8)).collect()
    component = {x["doc_id"]: x["component_id"] for x in got}
    assert {component[i] for i in range(2000)} == {0} and all(component[i] == i for i in range(2000, 2400))
