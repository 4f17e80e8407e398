"""Classifiers: held-out accuracy on the small tables, monotonicity, defined results."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import labels, quality_nbsvm, quality_rules, toxicity
from palimpsest.llm.text_stats import STATISTICS

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def auc(label, score):
    order = np.argsort(np.argsort(score)) + 1
    n1 = int((label == 1).sum())
    return (order[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


@needs_data
@pytest.mark.parametrize(("operator", "label", "least"), [(quality_nbsvm.quality, "quality", 0.95), (toxicity.toxicity, "toxic", 0.8)])
def test_held_out(spark, operator, label, least):
    docs, known = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = operator(docs, known).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out))
    joined = got.merge(known.toPandas(), on="doc_id")
    held = joined[joined.held_out]
    assert auc(held[label].to_numpy(), held.score.to_numpy()) > least


@pytest.mark.parametrize("operator", [quality_nbsvm.quality, toxicity.toxicity])
def test_edges(spark, operator):
    docs = [(1, "good text"), (2, None), (3, ""), (4, " \n"), (None, "x"), (5, "y " * 60000), (5, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("s"), "label": F.lit(1), "lang": F.lit(None).cast("string")})
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = operator(df, none).collect()
    assert len(got) == len(docs) and {r["score"] for r in got} == {0.5}
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 6)] + [(1, 1, 1)], "doc_id long, quality int, toxic int")
    again = operator(df, some).collect()
    assert len(again) == len(docs) and all(0 <= r["score"] <= 1 for r in again)
    assert operator(df.limit(0), some.limit(0)).count() == 0


def test_label_leaks_nothing(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} text") for i in range(60)], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    held = spark.createDataFrame([(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 5 == 0 else i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    a, b = ({r["doc_id"]: r["score"] for r in quality_nbsvm.quality(docs, x).collect()} for x in (known, held))
    assert a == b


def test_trees_are_monotone_and_learn():
    r = np.random.default_rng(2)
    x = r.random((1500, len(STATISTICS)))
    down = STATISTICS.index("symbols_per_word")
    y = ((x[:, down] < 0.6) & (x[:, 0] > 0.3) | (r.random(1500) < 0.05)).astype(int)
    forest = quality_rules.train(x, y)
    p = forest.score(x)
    assert auc(y, p) > 0.9
    probe = np.repeat(x[:50], 40, axis=0)
    probe[:, down] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(forest.score(probe).reshape(50, 40), axis=1) <= 1e-12).all()


def test_thresholds_by_language(spark):
    r = np.random.default_rng(1)
    y = np.arange(200) % 2
    assert toxicity.best_threshold(np.where(y == 1, 0.8, 0.1), y) == 0.5
    assert toxicity.best_threshold(np.where(y == 1, 0.3, 0.1), y) in (0.15, 0.2, 0.25, 0.3)
    rows = [r.integers(1, 50, (20, 3)).astype(np.int32) for _ in range(400)]
    label = r.integers(0, 2, 400)
    for x, bad in zip(rows, label):
        if bad:
            x[5] = 77
    net = toxicity.train(rows, label, ["a" if k % 3 else "b" for k in range(400)], passes=3, least=20)
    assert set(net.thresholds) == {"a", "b"} and all(0 < t < 1 for t in net.thresholds.values())
    net.thresholds = {"a": 0.9, "b": 0.2}
    df = spark.createDataFrame([("a", 0.8), ("b", 0.3), ("c", 0.6), (None, 0.4)], "lang string, score double")
    assert [x[0] for x in df.select(toxicity.by_language(F.col("score"), F.col("lang"), net)).collect()] == [False, True, True, False]


def test_network_equals_plain_forward_pass():
    net = toxicity.Network.fresh(3)
    net.bases = [b + 0.01 for b in net.bases]
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 30):
        buckets = r.integers(0, toxicity.BUCKETS, (n, len(toxicity.PREFIXES) + 1)).astype(np.int32)
        pooled = []
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0
                for at in range(n - width + 1):
                    total = float(net.bases[k][f])
                    for j in range(width):
                        vector = sum(net.table[b] for b in buckets[at + j])
                        total += float(sum(vector[d] * net.filters[k][j * toxicity.DIM + d, f] for d in range(toxicity.DIM)))
                    best = max(best, total)
                pooled.append(best)
        margin = sum(p * t for p, t in zip(pooled, net.top)) + net.bias
        assert abs(net.score(buckets) - 1 / (1 + np.exp(-margin))) < 1e-5


def test_long_texts_are_pooled_in_chunks(monkeypatch):
    net = toxicity.Network.fresh(3)
    buckets = np.random.default_rng(5).integers(0, toxicity.BUCKETS, (60, 3)).astype(np.int32)
    whole = net.score(buckets)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    assert abs(net.score(buckets) - whole) < 1e-6


def test_hinge_model_equals_plain_solver():
    """Dual coordinate descent against projected gradient ascent on the same dual."""
    r = np.random.default_rng(6)
    rows = [np.unique(r.integers(0, 40, 12)) for _ in range(60)]
    y = np.where(np.array([3 in x or 7 in x for x in rows]), 1, -1)
    scale, cost = r.normal(0, 1, 40), np.full(60, 0.7)
    w, bias = quality_nbsvm.dual_descent(rows, y, scale, cost, passes=2000)
    x = np.zeros((60, 41))
    for i, f in enumerate(rows):
        x[i, f] = scale[f] / np.sqrt(len(f))
    x[:, 40] = 1
    gram = (x * y[:, None]) @ (x * y[:, None]).T
    alpha = np.zeros(60)
    for _ in range(60_000):
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, cost)
    want = (alpha * y) @ x
    objective = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    mine = np.append(w, bias)
    assert objective(mine) <= objective(want) * 1.01 and np.abs(x @ mine - x @ want).max() < 0.1


def test_log_count_ratios_by_hand():
    rows = [np.array([1, 2]), np.array([1]), np.array([2, 3])]
    ratio = quality_nbsvm.log_count_ratios(rows, np.array([1, 1, -1]))
    assert np.isclose(ratio[1], np.log((3 / 3) / (1 / 2))) and np.isclose(ratio[2], np.log((2 / 3) / (2 / 2))) and np.isclose(ratio[3], np.log((1 / 3) / (2 / 2)))


def test_features_by_hand():
    tokens = quality_nbsvm._Tokens()
    assert len(quality_nbsvm.features(b"word", tokens)) == 2 and len(quality_nbsvm.features(b"", tokens)) == 0
    assert set(quality_nbsvm.features(b"a b", tokens)) <= set(quality_nbsvm.features(b"x a b", tokens))
    assert quality_nbsvm._shape(b"Ab12--c") == b"Aa9-a"


def test_flat_trees_equal_a_recursive_walk():
    r = np.random.default_rng(3)
    x = r.random((800, len(STATISTICS)))
    forest = quality_rules.train(x, (x[:, 0] + x[:, 2] > 1).astype(int))

    def walk(node, row):
        if forest.left[node] == node:
            return forest.value[node]
        return walk(forest.left[node] if row[forest.feature[node]] <= forest.bound[node] else forest.right[node], row)

    for row in r.random((100, len(STATISTICS))):
        margin = forest.start + sum(walk(root, row) for root in forest.root)
        assert np.isclose(forest.score(row[None])[0], 1 / (1 + np.exp(-margin)))


def test_kept_follows_base_rules_and_trees(spark):
    good = [f"plain words number {i} " + " ".join(f"w{i}_{k}" for k in range(60)) for i in range(80)]
    bad = [f"junk {i} " + " ".join(f"@@{k} ## $$" for k in range(40)) for i in range(80)]
    docs = spark.createDataFrame(list(enumerate(good + bad + ["short"])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(docs, labels).collect()
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.KEEP) for r in got)
    assert all(r["kept"] == (r["doc_id"] < 80) for r in got)


def test_a_label_is_one_row_whatever_its_texts(spark):
    docs = spark.range(60_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    more = spark.createDataFrame([(8, "long " * 30_000), (9, None), (None, "x")], "doc_id long, text string")
    known = spark.createDataFrame([(i, 1, 0) for i in range(1, 30)] + [(7, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["text"], r["label"]) for r in labels.labelled(docs.unionByName(more), known, "quality", 4000).collect()}
    held = {i for i in (7, 8, 9) if zlib.crc32(str(i).encode()) % 5 == 0}
    want = {7: ("t0", 0), 9: ("", 1)}
    assert got == {k: v for k, v in want.items() if k not in held} and len(got) >= 1
