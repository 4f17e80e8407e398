"""Source divergence and filter interactions against plain loops."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import filter_audit, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(docs, least, top=10):
    """Dense: every group gives every kept term, every pair sums over all of them."""
    seen, uses = defaultdict(Counter), defaultdict(Counter)
    groups = {(lang or "", source or "") for _, text, lang, source in docs}
    for _, text, lang, source in docs:
        words = TERM.findall((text or "").translate(UPPER))
        seen[lang or ""].update(set(words))
        uses[lang or "", source or ""].update(words)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        mine = sorted(s for g, s in groups if g == lang)
        share = {}
        for s in [*mine, None]:
            count = {t: sum(uses[lang, m][t] for m in (mine if s is None else [s])) for t in kept}
            total = sum(count.values())
            share[s] = {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in mine:
            pairs = sorted((-sum(f(share[s][t], share[o][t]) for t in kept), o.encode()) for o in mine if o != s)
            terms = sorted((-f(share[s][t], share[None][t]), t.encode()) for t in kept if uses[lang, s][t] and share[s][t] > share[None][t])
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(terms[:top])]
    return sorted(out)


def odd_documents(seed=1, n=160):
    r = random.Random(seed)
    vocabulary = [f"{c}wort" for c in "abcdefghijklmnopqrstuvwxyz"] + ["É", "é", "ÄÖ", "中文", "a𝒳b", "The", "THE", "the"]
    docs = []
    for i in range(n):
        source = r.choice(["hot"] * 4 + ["s1", "s2", None, "", "zé"])
        lang = r.choice(["en", "en", "de", None, ""])
        own = vocabulary[:: 2 if source == "hot" else 3]
        text = "".join(r.choice(own) + r.choice([" ", "\n", "7", "-", "\x00", "[", "`", "\x7f"]) for _ in range(r.choice([0, 1, 5, 60])))
        docs.append((i, r.choice([None, "", "12 34"]) if i % 17 == 0 else text, lang, source))
    return docs + docs[:5] + [(None, "the the The", "en", "s1"), (900, "lone words", "xx", "only"), (901, None, "yy", "a"), (902, "rare", "yy", "b")]


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("chunk,slice_bytes", [(400_000, 16_000_000), (3, 40)])
def test_divergence_equals_brute_force(spark, monkeypatch, chunk, slice_bytes):
    monkeypatch.setattr(source_divergence, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(source_divergence, "SLICE_BYTES", slice_bytes)
    docs = odd_documents()
    df = spark.createDataFrame(docs, SCHEMA)
    for c in ("term", "n", "p", "zero", "value", "rank", "nth", "body", "other"):
        df = df.withColumn(c, F.lit("x"))
    got = sorted(tuple(r) for r in source_divergence.source_divergence(df.repartition(3), least_docs=10).collect())
    assert got == brute_divergence(docs, 10) and {r[2] for r in got} == {"pair", "term"}
    assert source_divergence.source_divergence(df.limit(0)).count() == 0


def test_divergence_of_large_counts(spark):
    """Shares of counts beyond 9.2e9 need more than 64 bits on the way."""
    counts = [0, 1, 10**10, 9 * 10**12]
    total, terms = sum(counts), 4
    df = spark.createDataFrame([(c, total, terms) for c in counts], "c long, t long, v long")
    got = [r[0] for r in df.select(source_divergence.share(F.col("c"), F.col("t"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 2) // (total + 2 * terms) for c in counts]


def test_divergence_of_one_kept_term(spark):
    docs = [(i, "word", "en", f"s{i % 2}") for i in range(12)]
    got = sorted(tuple(r) for r in source_divergence.source_divergence(spark.createDataFrame(docs, SCHEMA)).collect())
    assert got == brute_divergence(docs, 10) == [("en", "s0", "pair", "s1", 0, 1), ("en", "s1", "pair", "s0", 0, 1)]


def brute_filters(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    for d, text, _, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    flagged = []
    for d, text, _, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        bad = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), d is not None and d > first[text]]
        flagged.append((source or "", dict(zip("ABCDE", bad)), d in good, d in toxic))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {f[0] for f in flagged}:
            for step in range(1, 6):
                out[part, order, step] = [0] * 6
        for part, bad, is_good, is_toxic in flagged:
            gone = False
            for step, x in enumerate(order, 1):
                row = out[part, order, step]
                here = bad[x] and not gone
                row[2] += bad[x] and gone
                row[3] += bad[x] and sum(bad.values()) == 1
                gone |= here
                row[0] += not gone
                row[1] += here
                row[4] += here and is_good
                row[5] += here and is_toxic
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_interactions_equal_brute_force(spark):
    r = random.Random(5)
    texts = [None, "", " \t\n", "x " * 250, "a b #", "ABC def"] + [" ".join(r.choice("abcdefghij") * r.randint(1, 30) + str(r.randint(0, 400)) * (k % 2) for _ in range(r.choice([50, 199, 200, 230]))) + r.choice(["", " $", " ÄÖ𝒳 BIG", " WORDS" * 30]) for k in range(30)]
    docs = [(i, r.choice(texts), "en", r.choice(["hot"] * 5 + ["s1", None, ""])) for i in range(180)]
    docs += docs[:6] + [(None, texts[4], "en", "s1"), (None, texts[4], "en", "s1"), (999, texts[7], None, "last")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 180, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (5000, 1, 1)]
    df = spark.createDataFrame(docs, SCHEMA)
    for c in ("part", "A", "E", "good", "digest", "n", "first", "fails", "step", "body"):
        df = df.withColumn(c, F.lit("x"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("y")).withColumn("good", F.lit(7))
    rows = filter_audit.filter_interactions(df.repartition(3), known).collect()
    got = {(x["part"], x["filter_order"], x["step"]): (x["kept"], x["removed"], x["redundant"], x["unique_fails"], x["good_lost"], x["toxic_lost"], x["shapley"]) for x in rows}
    assert len(rows) == len(got) and got == brute_filters(docs, labels)
    assert filter_audit.filter_interactions(df.limit(0), known).count() == 0
    none = filter_audit.filter_interactions(df, known.limit(0)).agg(F.sum("good_lost"), F.sum("removed")).first()
    assert none[0] == 0 and none[1] > 0


def test_audit_sql_equals_brute_force():
    import duckdb
    import pandas as pd

    docs = [d for d in odd_documents(3) if d[0] is not None]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source"]))
    con.register("labels", pd.DataFrame([(i, i % 2, i % 3) for i in range(0, 160, 3)], columns=["doc_id", "quality", "toxic"]))
    got = con.execute(source_divergence.DIVERGENCE_SQL).fetchall()
    assert sorted(got) == brute_divergence(docs, 10)
    found = con.execute(filter_audit.FILTER_SQL).fetchall()
    assert {r[:3]: r[3:] for r in found} == brute_filters(docs, [(i, i % 2, i % 3) for i in range(0, 160, 3)])
