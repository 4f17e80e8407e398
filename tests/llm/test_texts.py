"""Decontamination, PII, chat, packing, counts and rules against brute force."""

import functools
import hashlib
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat, decontaminate, licenses, packing, pii, quality_rules, text_stats, token_counts
from palimpsest.llm.common import WordHashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_contamination(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(width, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
                    found |= windows[tuple(w[j : j + k])]
        found.discard(None)
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short phrase"), (2, "short phrase"), (3, "x x x x x x x x x x x"), (4, None), (5, "..."), (None, "no id here"), (10, "solo"), (6, "never seen words at all in any document of this test ok")]
DOCS = [
    (1, "Alpha, BETA gamma-delta epsilon zeta eta theta iota kappa lambda MU end"),
    (2, "a short phrase! short\nphrase"),
    (3, "x " * 40),
    (4, None),
    (5, ""),
    (6, "alpha beta gamma delta epsilon zeta eta theta iota other kappa"),
    (7, "é solo ü" + " y" * 5000),
    (7, "é solo ü" + " y" * 5000),
    (7, "other text with no id here"),
    (None, "short phrase without id"),
]


def test_contamination_equals_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({"words": F.lit(1), "marks": F.lit(2), "d": F.lit(3), "maybe": F.lit(0)})
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.contamination(docs, items, slop=None).collect()), key=str)
    assert got == brute_contamination(DOCS, ITEMS)
    clean = sorted(str(r["doc_id"]) for r in decontaminate.keep_clean(docs, items).collect())
    assert clean == ["4", "5", "6"]
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    none = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(none) == len(DOCS) and not any(r["contaminated"] for r in none)


def brute_near(docs, items, width=10, slop=3):
    """Items of which a window has an offset with every word within ``slop`` words of its place."""
    out = []
    for _, t in docs:
        w, near = words(t), set()
        for item, text in items:
            v = words(text)
            k = min(width, len(v))
            for shift in range(-len(v) - slop, len(w) + slop + 1):
                stands = [v[j] in w[max(0, shift + j - slop) : max(0, shift + j + slop + 1)] for j in range(len(v))]
                if any(all(stands[s : s + k]) for s in range(len(v) - k + 1) if k):
                    near.add(item)
                    break
        out.append(len(near - {None}))
    return out


def test_one_inserted_word_stays_near(spark):
    """A ten-word item with a word inserted at each inner place, its end words the rarest."""
    item = "first " + " ".join(f"m{i}" for i in range(8)) + " last"
    docs = []
    for k in range(1, 10):
        w = item.split()
        docs.append((k, " ".join([*w[:k], "inserted", *w[k:]])))
    docs += [(100 + i, " ".join(f"m{k}" for k in range(8))) for i in range(20)]
    items = [(1, item)]
    got = {r["doc_id"]: r["n_near"] for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [got[k] for k in range(1, 10)] == [1] * 9 and got[100] == 0


@pytest.mark.parametrize("slop", [0, 1, 7])
def test_proximity_of_any_slop(spark, slop):
    import random

    r = random.Random(slop)
    items = [(i, " ".join(r.choice("abcdefghijkl") for _ in range(n))) for i, n in enumerate([1, 3, 10, 14])]
    docs = list(enumerate(" ".join(r.choice("abcdefghijklmno") for _ in range(r.randrange(40))) for _ in range(60)))
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, known, slop=slop).orderBy("doc_id").collect()
    assert [x["n_near"] for x in got] == brute_near(docs, items, slop=slop)
    with pytest.raises(ValueError):
        decontaminate.contamination(df, known, slop=8)


def test_proximity_equals_brute_force(spark):
    import random

    r = random.Random(11)
    vocabulary = [f"v{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 5, 10, 12, 30])] + [(6, "x " * 30), (None, "a b c"), (7, "a b c d")]
    texts = [None, "", "a c b d", "d c a b a b c d", "x " * 40]
    for _ in range(60):
        w = r.choice(items)[1].split()
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randrange(2)] = [r.choice(vocabulary)] * r.randrange(2)
        texts.append(" ".join([r.choice(vocabulary) for _ in range(r.randrange(6))] + w))
    docs = list(enumerate(texts))
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    assert [x["n_near"] for x in got] == brute_near(docs, items)
    assert all(x["n_near"] >= x["n_items"] for x in got) and any(x["n_near"] > x["n_items"] for x in got)


def test_repetitive_document_and_item(spark):
    docs = spark.createDataFrame([(1, "x " * 20_000), (2, "y x " * 5_000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x " * 100), (2, "x y " * 50)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (20_000, 20_000, 1), 2: (10_000, 10_000, 1)}


def py_feistel(left, right, a, b, key, tweak):
    f = lambda i, h: int(hashlib.sha256(f"{key}|{tweak}|{i}|{h}".encode()).hexdigest()[:15], 16)
    for i in range(1, pii.ROUNDS + 1):
        if i % 2 == 0:
            left = (left + f(i, right) % a) % a
        else:
            right = (right + f(i, left) % b) % b
    return left, right


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def test_feistel_is_the_same_in_python_and_a_permutation(spark):
    a, b = 7, 11
    pairs = spark.range(a * b).select((F.col("id") / b).cast("long").alias("l"), (F.col("id") % b).alias("r"))
    rows = pairs.select("l", "r", pii.feistel(F.col("l"), F.col("r"), F.lit(a), F.lit(b), "k", F.lit("t")).alias("p")).collect()
    assert len({tuple(r["p"]) for r in rows}) == a * b
    assert all(tuple(r["p"]) == py_feistel(r["l"], r["r"], a, b, "k", "t") for r in rows)


def test_pseudonyms(spark):
    texts = {
        "card": ("pay 4111111111111111 or 4111 1111 1111 1111, not 4111111111111112", r"\d{4} \d{4} \d{4} \d{4}|\d{16}"),
        "phone": ("call +1 (499) 555-6503%%% now", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
        "ip": ("from 10.20.30.40 not 300.1.1.1", r"\d+\.\d+\.\d+\.\d+"),
        "iban": ("DE89 3704 0044 0532 0130 00 and DE88370400440532013000", r"DE\d\d[ \d]+"),
        "date": ("born 1985-02-28, 31.12.2001, 02/30/1985", r"\d+[-./]\d+[-./]\d+"),
        "ssn": ("SSN 123-45-6789 and 666-12-1234", r"\d{3}-\d{2}-\d{4}"),
        "email": ("mail Foo.bar@mail7.example.com!", r"\S+@\S+"),
        "secret": ('token = "1eb9c654e721b4f812081eb9c654e721"', r'"\w+"'),
    }
    data = [(i, t) for i, (t, _) in enumerate(texts.values())] + [(90, None), (91, ""), (92, "no values 12 here"), (93, "x " * 60000 + "4111111111111111")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"kinds": F.lit(1), "extra": F.lit("e")})
    got = {r["doc_id"]: r for r in pii.pseudonyms(df, "k").collect()}
    for i, (kind, (text, shape)) in enumerate(texts.items()):
        assert got[i]["kinds"] == kind and got[i]["n_replaced"] >= 1, kind
        old, new = re.findall(shape, text), re.findall(shape, got[i]["text"])
        assert old[0] not in got[i]["text"] and len(new) == len(old), (kind, got[i]["text"])
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", got[0]["text"])
    assert luhn(cards[0]) and cards[0] == cards[1].replace(" ", "") and cards[2] == "4111111111111112"
    half = lambda s: (int(s[:7]), int(s[7:15]))
    left, right = py_feistel(*half("411111111111111"), 10**7, 10**8, "k", "card:15")
    assert cards[0][:15] == f"{left:07d}{right:08d}"
    assert "300.1.1.1" in got[2]["text"] and "666-12-1234" in got[5]["text"] and "02/30/1985" in got[4]["text"]
    moved = re.sub(" ", "", re.search(r"DE\d\d[ \d]+", got[3]["text"])[0])
    assert int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1 and "DE88370400440532013000" in got[3]["text"]
    assert [got[k]["text"] for k in (90, 91, 92)] == [None, "", "no values 12 here"]
    assert got[93]["text"].endswith(cards[0]) and len(got[93]["text"]) == 120016
    assert pii.pseudonyms(df, "other").filter("doc_id = 0").first()["text"] != got[0]["text"]


def test_pseudonyms_beside_other_numbers(spark):
    cases = {  # text, values that must go, what must stay, kinds
        "4111 1111 1111 1111 12/25": (["4111 1111 1111 1111"], "12/25", "card"),
        "4111111111111111 123": (["4111111111111111"], " 123", "card"),
        "378282246310005 4111 1111 1111 1111 99": (["378282246310005", "4111 1111 1111 1111"], " 99", "card"),
        "7 4111-1111-1111-1111 7": (["4111-1111-1111-1111"], "7 ", "card"),
        "4111 1111 1111 1111 123-45-6789": (["4111 1111 1111 1111", "123-45-6789"], "", "card,ssn"),
        "4111 1111 1111 1111 12/25/2024 x": (["4111 1111 1111 1111", "12/25/2024"], " x", "card,date"),
        "ES91 2100 0418 4502 0005 1332 I paid": (["2100 0418 4502 0005 1332"], " I paid", "iban"),
        "BE68 5390 0754 7034 OK then": (["5390 0754 7034"], " OK then", "iban"),
        "ES91 2100 0418 4502 0005 1332 BE68 5390 0754 7034 4111-1111-1111-1111": (["2100 0418 4502", "5390 0754 7034", "4111-1111-1111-1111"], "BE", "card,iban"),
        "+44 20 7946 0958 now": (["7946 0958"], " now", "phone"),
        "+49 30 12345678": (["12345678"], "+", "phone"),
        "+33 1 42 68 53 00.": (["42 68 53 00"], ".", "phone"),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonyms(df, "k").collect()}
    for i, (text, (gone, stays, kinds)) in enumerate(cases.items()):
        out = got[i]["text"]
        assert got[i]["kinds"] == kinds and got[i]["n_replaced"] == len(gone), (text, got[i])
        assert not any(v in out for v in gone) and stays in out and re.sub("[0-9]", "0", out) == re.sub("[0-9]", "0", text), (text, out)


def test_dates_are_permuted_within_their_span(spark):
    days = spark.range(0, 36525, 5).select(F.date_add(F.lit("1901-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    out = days.select(pii._permuted_date(F.col("d"), "k").alias("p"))
    row = out.agg(F.count_distinct("p"), F.min("p"), F.max("p"), F.count("*")).first()
    assert row[0] == row[3] and str(row[1]) >= "1901-01-01" and str(row[2]) <= "2000-12-31"


def test_chat_keeps_maximal_conversations(spark):
    say = lambda c, *texts: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    data = say(1, "a", "b") + say(2, "a", "b", "c", "d") + say(3, "a", "b", "c", "d") + say(4, "a", "x") + say(5, None, "b") + say(6, "", "b") + [(7, None, "user", "n"), (7, 0, "user", "m"), (7, 0, "user", "m"), (None, 0, "user", "z")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit(1), "c": F.lit(2)})
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.chat_texts(df).groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.first("rendered").alias("rendered")).collect()}
    assert set(got) == {2, 4, 5, 6, 7, None}
    assert got[4] == (2, "<|user|>\na<|end|>\n<|assistant|>\nx<|end|>\n")
    assert got[7][0] == 2
    assert chat.chat_texts(df.limit(0)).count() == 0


def test_chat_rows_without_conversation(spark):
    data = [(1, 0, "user", "a"), (1, 1, "user", "b"), (None, 0, "user", "a"), (None, 0, "user", "z"), (None, 0, "user", "z"), (None, 5, "user", None), (2, 0, "user", "q"), (None, 0, "user", "q")]
    got = chat.chat_texts(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    assert sorted((str(r["conv_id"]), r["n_turns"], r["rendered"]) for r in got.collect()) == [
        ("1", 2, "<|user|>\na<|end|>\n<|user|>\nb<|end|>\n"),
        ("2", 1, "<|user|>\nq<|end|>\n"),
        ("None", 1, "<|user|>\n<|end|>\n"),
        ("None", 1, "<|user|>\nz<|end|>\n"),
    ]


def brute_chat(data):
    """Maximal conversations by comparing lists of turns."""
    by = {}
    for k, (c, turn, role, text) in enumerate(dict.fromkeys(data)):
        by.setdefault(c if c is not None else ("row", k), set()).add((turn, role or "", text or "", role is None, text is None))
    lists = {c: sorted(t) for c, t in by.items()}
    cut = lambda t: [t[:i] for i in range(1, len(t) + 1) if i == len(t) or t[i][0] != t[i - 1][0]]
    prefixes = {str(p) for t in lists.values() for p in cut(t)[:-1]}
    best = {}
    for c, t in lists.items():
        if str(t) not in prefixes:
            best[str(t)] = min(best.get(str(t), c), c) if not isinstance(c, tuple) else best.get(str(t), c)
    return sorted((None if isinstance(c, tuple) else c, "".join(f"<|{r}|>\n{t}<|end|>\n" for _, r, t, _, _ in lists[c])) for c in best.values())


def test_chat_equals_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(chat, "BLOCK", 3)
    r = random.Random(6)
    data = []
    for c in range(120):
        start = r.randint(0, 2)
        data += [(c, i, r.choice("ua") if r.random() < 0.1 else "u", f"t{i}" if r.random() < 0.93 else r.choice(["x", "", None])) for i in range(start, start + r.randint(1, 9))]
    data += r.sample(data, 40) + [(c, 4, "a", "second at its number") for c in range(0, 120, 17)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = chat.whole_conversations(chat.chat_texts(df)).collect()
    assert sorted((x["conv_id"], x["rendered"]) for x in got) == brute_chat(data)


def test_chat_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    data = [(1, i, "u", f"t{i}") for i in range(23)] + [(2, i, "u", f"t{i}") for i in range(17)] + [(3, i, "u", f"t{i}" if i != 9 else "other") for i in range(17)]
    got = chat.chat_texts(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()
    assert sorted({r["conv_id"] for r in got}) == [1, 3] and sum(r["n_turns"] for r in got) == 40


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_files()[0])


def tokens(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def test_packing_round_trip(spark):
    texts = [None, "", "a", "hello world " * 900, "x  y\n\n z<|endoftext|> tail", "é中文 's  \t mixed", "word " * 40] + ["some words here %d" % i * (i % 17) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(6, texts[6]), (None, "no id")], "doc_id long, text string").withColumn("bin", F.lit(1))
    got = packing.pack(df, with_ids=True).toPandas()
    by = got.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id").length.cumsum() - by.length == by.offset).all() and by.groupby("sequence_id").length.sum().max() <= 2048
    for i, t in enumerate(texts):
        if i == 6:
            continue
        mine = got[got.doc_id == i].sort_values("start")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in mine.ids])
        assert ids.tolist() == tokens(t)
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.doc_tokens == len(ids) for r in mine.itertuples())
    assert len(got[got.doc_id == 6]) == 2 and got.doc_id.isna().sum() == 1
    assert packing.pack(df.limit(0)).count() == 0


def test_cutting_stock_is_tight():
    r = np.random.default_rng(1)
    demand = np.zeros(256, np.int64)
    np.add.at(demand, np.minimum(255, r.exponential(50, 4000).astype(int)), 1)
    plan = packing.plan_sequences(demand)
    bins = np.repeat(np.arange(256), demand)
    ranks = np.concatenate([np.arange(n) for n in demand])
    where = plan.place(bins, ranks)
    load = np.bincount(where, bins + 1, plan.sequences)
    assert load.max() <= 256 and plan.sequences <= np.ceil((bins + 1).sum() / 256) * 1.03 + 2
    value, pattern = packing.best_pattern(np.array([0.0, 0.3, 0.5, 0.0]), 4)
    assert value == pytest.approx(0.6) and pattern.tolist() == [0, 2, 0, 0]


ALL_BINS = """
import numpy as np
from pyspark.sql import SparkSession
from palimpsest.llm import packing
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.range(10).count() == 10
demand = np.arange(1255, 999, -1)
plan = packing.plan_sequences(demand)
bins = np.repeat(np.arange(256), demand)
load = np.bincount(plan.place(bins, np.concatenate([np.arange(n) for n in demand])), bins + 1, plan.sequences)
print(int(load.max()), plan.sequences - -(-int((bins + 1).sum()) // 256))
"""


def test_all_bins_in_the_process_of_a_session():
    """With every bin in use, beside a running session, within a time limit."""
    done = subprocess.run([sys.executable, "-c", ALL_BINS], capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    most, above = map(int, done.stdout.split()[-2:])
    assert most <= 256 and 0 <= above <= 8


@pytest.mark.parametrize("seed", range(4))
def test_first_basis_is_inverted_without_a_factorisation(seed):
    r = np.random.default_rng(seed)
    demand = r.integers(0, 50, 64) * (r.random(64) < 0.8)
    used = np.flatnonzero(demand)
    patterns, _, emptied = packing.first_patterns(demand)
    product = packing.triangular_inverse(patterns, emptied, used) @ patterns[:, used].T
    assert np.abs(product - np.eye(len(used))).max() < 1e-8


def test_ids_of_a_whole_table():
    """The ids of every text of a table are the tokenizer's."""
    import pyarrow.parquet as pq

    encoder = packing.Encoder(packing.tokenizer_files())
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    plain = tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(np.frombuffer(encoder.encode(t), "<u4").tolist() == p.ids for t, p in zip(texts, plain))


def test_encoder_on_odd_white_space():
    import random

    r, e = random.Random(3), packing.Encoder(packing.tokenizer_files())
    parts = [" ", "  ", "\n", "\t", "a", "b", "é", "1", "2", ".", "'s", '"', " ", "　", "中", "\r\n", "the", "\x1c", "\x85"]
    for _ in range(1500):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == tokens(t)[:-1], repr(t)


def plain_segments(word, scores):
    """Value (score, less tokens) and pieces of the best segmentation, over all cuts."""
    text = token_counts.MARK + word
    byte = min(scores.values()) - token_counts.BYTE_BELOW
    best = [((0, 0), [])]
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode())
        (value, count), used = best[end - 1]
        options = [((value + byte * size, count - size), used)]
        for b in reversed(range(end)):
            if text[b:end] in scores:
                (value, count), used = best[b]
                options.append(((value + scores[text[b:end]], count - 1), used + [text[b:end]]))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1]


def test_token_counts_equal_plain_dynamic_program(spark):
    texts = ["the cat sat", "internationalisation of éèê 中文字 \U0001f600", "", None, " \n ", "y" * 500 + " the the", "the cat sat", "the internationals\tinter"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit(1))
    scores = token_counts.first_scores(token_counts.vocabulary_file())
    for _ in range(token_counts.ROUNDS):
        used = {}
        for w in " ".join(t or "" for t in texts).split():
            for piece in plain_segments(w, scores)[1]:
                used[piece] = used.get(piece, 0) + 1
        scores = token_counts.next_scores(scores, used)
    assert token_counts.fit_scores(docs) == scores and scores["▁the"] > scores["▁cat"] > min(scores.values())
    got = token_counts.token_counts(docs).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        each = [plain_segments(w, scores)[0] for w in (t or "").split()]
        assert (r["n_words"], r["n_tokens"], r["score"]) == (len(each), -sum(x[1] for x in each), sum(x[0] for x in each))
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_trie_survives_its_bounds(monkeypatch):
    monkeypatch.setattr(token_counts, "NODES", 50)
    monkeypatch.setattr(token_counts, "WORDS", 7)
    monkeypatch.setattr(token_counts, "LONG", 12)
    scores = token_counts.first_scores(token_counts.vocabulary_file())
    counts = token_counts.TrieCounts(scores)
    for w in ["the", "cats", "internationalisation", "the", "a", "b", "c", "d", "e", "f", "the", "cat", "cats"] * 2:
        value, tokens = plain_segments(w, scores)[0]
        assert counts.text(w.encode()) == (1, -tokens, value)


def brute_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines, dup = (t or "").split("\n"), 0
    for i, line in enumerate(lines):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)]


def test_base_counts_equal_brute_force(spark):
    texts = ["a b c a b c", "x\nx\n\n\nx y\nx y", "é ü # $", "", None, " ", "a a a", "a a a a", "  b　c", "l\r\nl\r\n", "one two"]
    for t in texts:
        assert text_stats.base_counts(t.encode() if t is not None else None, WordHashes())[0] == brute_stats(t), t
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "w%d " * 3)], "doc_id long, text string").withColumn("kept", F.lit(1))
    got = quality_rules.quality_rules(docs, labels).collect()
    assert len(got) == len(texts) + 1 and all(r["base_failed"] and not r["kept"] for r in got)


def brute_licenses(text, threshold=licenses.THRESHOLD):
    grams = lambda t: {p for w in [re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))] for p in zip(w, w[1:])}
    out = set()
    for unit in [*(text or "").split("\n"), *re.split(r"\n[ \t]*\n", text or ""), text or ""]:
        a = grams(unit)
        for name, t in licenses.TEMPLATES.items():
            b = grams(t)
            if a and 2 * len(a & b) / (len(a) + len(b)) >= threshold:
                out.add(name)
    return ",".join(sorted(out))


def test_license_scan_equals_brute_force(spark):
    mit = licenses.TEMPLATES["MIT"]
    wrapped = "\n".join(re.findall(r".{1,70}(?:\s|$)", mit))
    texts = ["prose\nReleased under the MIT License.", "intro\n\n" + wrapped + "\n\nend", wrapped, "LICENSED UNDER CC BY-NC 4.0.!!", "all rights", "", None, "This work is licensed under the GNU General Public License, version 3", "x " * 50000, licenses.TEMPLATES["ISC"] + " with a few more words"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string").withColumn("licenses", F.lit(0))
    got = licenses.license_scan(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r["licenses"] == brute_licenses(texts[r["doc_id"]]), r
        assert (r["n_matches"] > 0) == bool(r["licenses"]) == (r["best_license"] is not None)


def test_licenses_inside_other_words():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    bsd = "Copyright (c) 2020 Jane Doe\nAll rights reserved.\n\n" + licenses.TEMPLATES["BSD-2-Clause-text"]
    mit = licenses.TEMPLATES["MIT-text"].replace(". ", ".\nCopyright 2021 John Roe\n", 1)
    cases = {
        "Copyright 2020 Jane Doe. All rights reserved.": {"AllRightsReserved"},
        "Released under the MIT License. See the LICENSE file.": {"MIT-line"},
        "some prose says that this was released under the MIT License by its owner in a long line": {"MIT-line"},
        bsd: {"AllRightsReserved", "BSD-2-Clause", "BSD-2-Clause-text"},
        "prose " * 300 + bsd.replace("\n", " ") + " more prose" * 300: {"BSD-2-Clause", "BSD-2-Clause-text"},
        "words before " * 50 + mit: {"MIT", "MIT-text"},
    }
    for text, names in cases.items():
        n_units, n_matches, best, _, found = scanner.text(text.encode())
        assert names <= set(found.split(",")) and 0 < n_matches <= n_units and best >= licenses.THRESHOLD, (text[:60], found)
    assert scanner.text(b"rights reserved " * 20000 + b"all rights")[1] == 1
    assert scanner.text(b"the rights of all were reserved under the law of the land")[1] == 0


def test_license_runs_equal_brute_force():
    import random

    rng = random.Random(3)
    scanner = licenses.Scanner({"T": "a b c d e f"}, licenses.THRESHOLD)
    want = {p for p in zip("abcde", "bcdef")}
    for _ in range(400):
        w = [rng.choice("abcdefx") if rng.random() < 0.4 else "abcdef"[i % 6] for i in range(rng.randint(2, 24))]
        sets = [set(zip(w[i:j], w[i + 1 : j])) for i in range(len(w)) for j in range(i + 2, len(w) + 1)]
        best = max(2 * len(s & want) / (len(s) + 5) for s in sets)
        got = dict((n, d) for d, n in scanner.runs(" ".join(w).encode(), licenses.bigrams(" ".join(w).encode(), scanner.words)[0], set()))
        assert got == ({"T": best} if best >= licenses.THRESHOLD else {}), w


def test_long_templates_by_arrays_equal_loops(monkeypatch):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    scanner = licenses.Scanner({"T": " ".join(words)}, licenses.THRESHOLD)
    for _ in range(60):
        body = words[rng.randrange(8) : 60 - rng.randrange(8)]
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(body))
            body[k : k + rng.randrange(2)] = rng.choices(words + ["x", "y"], k=rng.randrange(1, 4))
        text = " ".join(rng.choices(["x", "y", "w3", "w4"], k=rng.randrange(30)) + body + rng.choices(["x", "z", "w50"], k=rng.randrange(30))).encode()
        grams = licenses.bigrams(text, scanner.words)[0]
        by = []
        for least in (0, 10**9):
            monkeypatch.setattr(licenses, "ARRAYS_FROM", least)
            by.append(scanner.runs(text, grams, set()))
        assert by[0] == by[1], text


def test_whole_license_files(spark):
    texts = licenses.license_texts()
    assert {"Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0"} <= set(texts)
    docs = [(i, t) for i, t in enumerate(texts.values())] + [(100 + i, "Copyright 2020 X\n" + "prose before it " * 80 + t.replace("the", "the", 1) + " prose after it" * 80) for i, t in enumerate(texts.values())]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, name in enumerate(texts):
        assert f"{name}-text" in got[i]["licenses"].split(",") and got[i]["best_dice"] == 1.0
        assert f"{name}-text" in got[100 + i]["licenses"].split(","), name


def test_upper_share_counts_all_letters():
    at = text_stats.STATISTICS.index("upper_share")
    share = lambda t: text_stats.statistics(t.encode(), text_stats.WordHashes())[1][at]
    assert share("BCD xyz") == 0.5 and share("ÄÖ Жж é") == 0.6 and share("12 漢字") == 0.0
    letters = [c for c in "The QUICK brown Fox, ÜBER alles" if c.isupper() or c.islower()]
    assert share("The QUICK brown Fox, ÜBER alles") == sum(map(str.isupper, letters)) / len(letters)
