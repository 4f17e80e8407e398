"""Each stage of the corpus pipeline on odd rows, and the whole against its stages' brute force."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import decontaminate, packing, quality_nbsvm

OPENING = "the committee of river towns met in autumn and wrote a plain report about bridges, roads and the price of bread in the valley "
GOOD = [OPENING + " ".join(f"town{i}n{k}" for k in range(40)) for i in range(40)]
BAD = ["!!! $$$ BUY ### %d %% && WIN $$$ ??? now now now now now" % i for i in range(40)]
ITEM = "one two three four five six seven eight nine ten eleven"
SPECIAL = [
    (200, GOOD[3] + " card 4111 1111 1111 1111"),
    (201, GOOD[4].rsplit(" ", 1)[0] + " grain"),  # a near copy of 4
    (202, GOOD[5]),  # an exact copy of 5
    (202, GOOD[5]),  # a repeated row
    (203, GOOD[6] + " " + ITEM),
    (204, None),
    (205, ""),
    (None, GOOD[7] + " without a number of its own in the list of the towns that met"),
    (206, "the long road " * 20_000),
]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("pipe"))
    texts = [(i, t) for i, t in enumerate(GOOD + BAD)] + SPECIAL
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.coalesce(2).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").coalesce(1).write.parquet(f"{top}/benchmark.parquet")
    return top


def key(r):
    return (str(r["doc_id"]), r["text"] or "")


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "pii"])
def test_stage_keeps_columns_it_does_not_know(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.drop("n_chars").withColumns({"score": F.lit(-7.0), "n_replaced": F.lit(-5), "kinds": F.lit("mine"), "label": F.lit("l"), "node": F.lit(1), "Kept": F.lit("k"), "words": F.lit(0)})
    out = stage(spark, odd, sf)
    assert out.dtypes == odd.dtypes
    got = out.collect()
    assert got and all((r["score"], r["n_replaced"], r["kinds"], r["node"], r["Kept"]) == (-7.0, -5, "mine", 1, "k") for r in got)
    plain = stage(spark, docs, sf)
    assert plain.columns == docs.columns and sorted(map(key, plain.collect())) == sorted(map(key, got))
    assert stage(spark, docs.limit(0), sf).count() == 0


#: Names that the stages and what they call use for columns of their own.
INTERNAL = (
    "row body found fresh between hits n_hits hidden k0 s score label special_id special_kept doubtful maybe bucket bitmap bit place key node n fine component kept "
    "repeated hit_id hit_hash text_hash words term pos item marks d h shifts bands checked ids n_words n_hit bin rank nth salt base sequence_id offset length start"
).split()


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontamination", "pii"])
def test_stage_under_every_internal_name(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [c for c in [*INTERNAL, *[f"__{c}" for c in INTERNAL], *[f"_{c}" for c in INTERNAL]]]
    odd = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in names], F.create_map(F.lit("a"), F.col("doc_id")).alias("kinds_map"), F.lit(1).alias("a.b"))
    out = stage(spark, odd, sf)
    assert [c for c, _ in out.dtypes] == odd.columns and out.dtypes == odd.dtypes
    got = out.collect()
    assert sorted(map(key, got)) == sorted(map(key, stage(spark, docs, sf).collect()))
    assert all(r[c] == f"own {c}" for r in got for c in names) and all(r["kinds_map"] == {"a": r["doc_id"]} for r in got)


def test_decisions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    run = lambda name: dict(corpus_pipeline.STAGES)[name](spark, docs, sf).collect()
    every = sorted(map(key, docs.collect()))
    kept = {r["doc_id"] for r in run("quality")}
    assert set(range(40)) <= kept and not kept & set(range(40, 80))
    distinct = [r["doc_id"] for r in run("near_duplicates")]
    assert 201 not in distinct and 202 not in distinct and {4, 5, 204, 205, None} <= set(distinct) and len(distinct) == len(set(distinct))
    clean = sorted(map(key, run("decontamination")))
    assert clean == [k for k in every if k[0] != "203"]
    hidden = {str(r["doc_id"]): r for r in run("pii")}
    before = {str(r["doc_id"]): r for r in docs.collect()}
    assert "4111" not in hidden["200"]["text"] and hidden["200"]["n_chars"] == len(hidden["200"]["text"])
    assert all(hidden[k]["text"] == before[k]["text"] for k in hidden if k != "200")


def test_whole_run_equals_its_parts(spark, sf):
    got = corpus_pipeline.run(spark, sf).toPandas()
    docs, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in quality_nbsvm.quality(docs, known).filter("score >= 0.3").collect()}
    texts = {}
    for d, t in sorted(((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good and r["doc_id"] is not None), key=str):
        texts.setdefault(d, t)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(max(1, len(w) - 4)) if w}
    sets = {d: shingles(t) for d, t in texts.items()}
    kept = [d for d in sorted(texts) if not any(e < d and sets[d] and 100 * len(sets[d] & sets[e]) >= 85 * len(sets[d] | sets[e]) for e in sets)]
    kept = {d for d in kept if ITEM not in (texts[d] or "")}
    assert set(got.doc_id.dropna().astype(int)) == kept and got.doc_id.isna().sum() == (None in good)
    encoder = packing.Encoder(packing.tokenizer_files())
    for d in kept - {200}:
        mine = got[got.doc_id == d].sort_values("start")
        ids = encoder.encode(texts[d]) + b"\1\0\0\0"
        assert mine.length.sum() == len(ids) // 4
        assert [zlib.crc32(ids[4 * s : 4 * (s + n)]) for s, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert decontaminate.WINDOW == 10
