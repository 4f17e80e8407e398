"""Benchmark decontamination over a distributed positional inverted index.

The postings ``(document, position, term)`` of every training token whose term a
benchmark item uses are stored as a table.  Their counts give each item window its
two rarest terms; the offset-adjusted lists of those terms are intersected on
``(document, item, position - offset)``, and every alignment that survives is
compared word by word.  All of it is DataFrame operations.

Windows that repeat within an item are looked for once.  Per document and item only the
offsets are collected; the item's words stand beside them once.

Proximity: a window of an item is near if there is an offset at which each of its words stands
within ``slop`` words of its place.  Two terms of such a window stand at offsets that differ by
``2 * slop`` at most, so offsets are dealt to overlapping bands of twice that width: the two rarest
terms of a near window meet in some band.  In a band every word of the item is looked up once, as
bits of the offsets at which it stands, and windows are intersections of bits.

The vocabulary and the anchors follow the benchmark's size.  They are stored, so
Spark sees their size and broadcasts them only below its own threshold; beyond it
they are joined by shuffling, where adaptive execution splits frequent terms.

Defined results.  Null or wordless texts have no words, no hits and no windows.
Repeated document rows each get a row.  Rows of one item_id count as one item; a
null item_id marks words but is neither counted nor listed.  Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..operators.prefilter import KeyBitmap
from ..storage import discard, materialize

WINDOW, SLOP = 10, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words: runs of a-z, 0-9 and everything beyond ASCII, after lower-casing A-Z."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _documents(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), words_of(text).alias("words"))


def _items(items: DataFrame, window: int) -> DataFrame:
    text = F.col("text").cast("string")
    return (
        items.select("item_id", F.xxhash64(F.col("item_id"), text).alias("item"), words_of(text).alias("item_words"))
        .filter(F.size("item_words") > 0)
        .dropDuplicates(["item_id", "item"])
        .withColumn("width", F.least(F.lit(window), F.size("item_words")))
    )


def store_postings(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, pos, term)`` of the tokens whose term some item uses."""
    terms = materialize(items.select(F.explode("item_words").alias("w")).select(F.xxhash64("w").alias("term")).distinct(), "terms")
    tokens = docs.select("doc_id", "text_hash", F.posexplode("words").alias("pos", "w")).select("doc_id", "text_hash", "pos", F.xxhash64("w").alias("term"))
    return materialize(tokens.join(terms, "term").select("doc_id", "text_hash", "pos", "term"), "postings")


def distinct_windows(items: DataFrame) -> DataFrame:
    """``(item, start)``: the first start of every window of an item."""
    at = F.sequence(F.lit(0), F.size("item_words") - F.col("width"))
    spots = items.select("item", "item_words", "width", F.explode(at).alias("start"))
    return spots.groupBy("item", F.slice("item_words", F.col("start") + 1, F.col("width")).alias("w")).agg(F.min("start").alias("start")).select("item", "start")


def rarest_terms(postings: DataFrame, items: DataFrame, windows: DataFrame, terms: int = 2) -> DataFrame:
    """``(item, start, width, rare)``: the rarest terms of every distinct window that can occur."""
    counts = postings.groupBy("term").agg(F.count("*").alias("n"))
    last = F.size("item_words") - F.col("width")
    spots = items.select("item", "width", last.alias("last"), F.posexplode("item_words").alias("at", "w")).select("item", "width", "last", "at", F.xxhash64("w").alias("term"))
    return (
        spots.join(counts, "term", "left")
        .withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("width") + 1), F.least(F.col("at"), F.col("last")))))
        .join(windows, ["item", "start"], "left_semi")
        .groupBy("item", "start", "width")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term"))).alias("rare"))
        .filter(F.col("rare")[0]["n"] > 0)
        .withColumn("rare", F.slice("rare", 1, terms))
    )


def shifts_of(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, item, need, shift, lo, hi)``: offsets at which rare terms stand, with the first and last of them.

    Dealt by document and item once: what is grouped by these and more needs no further shuffle.
    """
    return (
        postings.join(anchors, "term")
        .select("doc_id", "text_hash", "item", "need", (F.col("pos") - F.col("at")).alias("shift"), "at")
        .repartition("doc_id", "text_hash", "item")
        .groupBy("doc_id", "text_hash", "item", "need", "shift")
        .agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    )


_LINED = "need < 2 or lo < hi"


def alignments(shifts: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, item, shift)``: where the rarest terms of a window line up."""
    return shifts.filter(_LINED).select("doc_id", "text_hash", "item", "shift")


def bands(shifts: DataFrame, slop: int) -> DataFrame:
    """``(doc_id, text_hash, item, band)``: bands of offsets in which two rare terms stand.

    Band ``b`` holds the offsets from ``(b - 1) * w`` to ``(b + 1) * w - 1``, ``w = 2 * slop + 1``; two
    offsets that differ by less than ``w`` have a band in common.
    """
    own = F.floor(F.col("shift") / (2 * slop + 1)).cast("int")
    dealt = shifts.withColumn("band", F.explode(F.array(own, own + 1)))
    return dealt.groupBy("doc_id", "text_hash", "item", "need", "band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter(_LINED).select("doc_id", "text_hash", "item", "band")


def _places(words: Column, m: Column) -> Column:
    """Places in the document of the item's windows that occur at one of its offsets, once each."""
    none = F.array().cast("array<int>")
    same = lambda shift, s: F.slice(words, shift + s + 1, m["width"]) == F.slice(m["item_words"], s + 1, m["width"])
    at = lambda shift: F.transform(F.filter(m["starts"], lambda s: (shift + s >= 0) & same(shift, s)), lambda s: shift + s)
    return F.array_distinct(F.coalesce(F.flatten(F.transform(m["shifts"], at)), none))


def _near_in_band(words: Column, m: Column, band: Column, slop: int) -> Column:
    """Whether a window is near at an offset of a band, or up to ``slop`` beside it."""
    wide = 2 * slop + 1
    places = 2 * wide + 4 * slop  # offsets at which a word of a near window may stand, 64 at most
    base = (band - 1) * wide - 2 * slop
    bit = lambda o: F.call_function("shiftleft", F.lit(1).cast("long"), o)
    offsets = F.sequence(F.lit(0), F.lit(places - 1))

    def standing(w: Column, j: Column) -> Column:
        return F.aggregate(offsets, F.lit(0).cast("long"), lambda acc, o: F.when(F.get(words, base + j + o) == w, acc.bitwiseOR(bit(o))).otherwise(acc))

    def spread(bits: Column) -> Column:
        out = bits
        for k in range(1, slop + 1):
            out = out.bitwiseOR(F.shiftleft(bits, k)).bitwiseOR(F.shiftrightunsigned(bits, k))
        return out

    # offsets whose whole surroundings were looked at
    inner = F.lit(sum(1 << o for o in range(slop, places - slop)))
    every = F.transform(F.zip_with(m["item_words"], F.sequence(F.lit(0), F.size(m["item_words"]) - 1), standing), lambda bits: let(bits, spread))
    whole = lambda near, s: F.aggregate(F.slice(near, s + 1, m["width"]), inner.cast("long"), lambda acc, x: acc.bitwiseAND(x)) != 0
    return let(every, lambda near: F.exists(m["starts"], lambda s: whole(near, s)))


def _covered(spans: Column) -> Column:
    """How many positions the spans (structs of first, end) cover, in one pass over the sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.greatest(F.lit(0), x["end"] - F.greatest(x["first"], acc["end"]))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["end"], x["end"]).alias("end"))

    return F.aggregate(F.array_sort(F.array_distinct(spans)), start, step, lambda acc: acc["n"])


def _marks(documents: DataFrame, items: DataFrame, slop: int | None) -> DataFrame:
    """``(d, h, marks)`` of every document with an offset: its items with their words, windows, offsets and bands."""
    postings = store_postings(documents, items)
    windows = materialize(distinct_windows(items), "windows")
    rare = rarest_terms(postings, items, windows)
    anchors = materialize(rare.select("item", F.least("width", F.lit(2)).alias("need"), F.explode("rare").alias("r")).select("item", "need", F.col("r.at").alias("at"), F.col("r.term").alias("term")).distinct(), "anchors")
    starts = windows.groupBy("item").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    every = shifts_of(postings, anchors)
    spots = alignments(every).withColumn("band", F.lit(None).cast("int"))
    if slop is not None:
        spots = spots.unionByName(bands(every, slop).withColumn("shift", F.lit(None).cast("int")))
    shifts = spots.groupBy("doc_id", "text_hash", "item").agg(F.array_sort(F.collect_list("shift")).alias("shifts"), F.array_sort(F.collect_list("band")).alias("bands"))
    found = shifts.join(items.join(starts, "item"), "item")
    mark = F.struct("item_id", "shifts", "bands", "width", "item_words", "starts")
    out = materialize(found.groupBy("doc_id", "text_hash").agg(F.collect_list(mark).alias("marks")).withColumnsRenamed({"doc_id": "d", "text_hash": "h"}), "alignments")
    for df in (postings, windows, anchors):
        discard(df)
    return out


_CHECKED = "array<struct<item_id:long,width:int,exact:array<int>,near:boolean>>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keyed: bool = False, slop: int | None = SLOP) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near)`` per row of ``docs``.

    ``n_near`` counts the items of which a window is near (or occurs); it is left out where
    ``slop`` is None.  ``keyed`` adds ``text_hash``, which tells the texts of one doc_id apart.
    """
    key = ["doc_id", *["text_hash"] * keyed]
    documents = _documents(docs)
    items = materialize(_items(benchmark, window), "items")
    if slop is not None and not 0 <= slop <= 7:
        raise ValueError("slop must be from 0 to 7")
    per_doc = _marks(documents, items, slop)
    discard(items)
    exact = lambda m: _places(F.col("words"), m)
    near = lambda m, found: F.lit(False) if slop is None else (F.size(found) > 0) | F.exists(m["bands"], lambda b: _near_in_band(F.col("words"), m, b, slop))
    checked = F.transform("marks", lambda m: let(exact(m), lambda e: F.struct(m["item_id"].alias("item_id"), m["width"].alias("width"), e.alias("exact"), near(m, e).alias("near"))))
    occurring = F.filter("checked", lambda m: F.size(m["exact"]) > 0)
    spans = F.flatten(F.transform(occurring, lambda m: F.transform(m["exact"], lambda p: F.struct(p.alias("first"), (p + m["width"]).alias("end")))))
    named = lambda kept: F.array_distinct(F.filter(F.transform(kept, lambda m: m["item_id"].cast("string")), lambda x: x.isNotNull()))
    # only the texts of documents with an alignment go through the join
    marked = KeyBitmap(per_doc, F.xxhash64("h", "d")).mark(documents, F.xxhash64("text_hash", "doc_id"))
    slim = marked.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.when(F.col("maybe"), F.col("text")).alias("text"))
    counts = [F.size(named(F.filter("checked", lambda m: m["near"]))).cast("long").alias("n_near")] * (slop is not None)
    return (
        slim.join(per_doc, (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
        .select(*key, "n_words", "marks", F.when(F.col("marks").isNotNull(), words_of(F.col("text"))).alias("words"))
        .select(*key, "n_words", F.coalesce(F.when(F.col("marks").isNotNull(), checked), F.array().cast(_CHECKED)).alias("checked"))
        .select(*key, "n_words", _covered(spans).alias("n_hit"), F.array_sort(named(occurring)).alias("ids"), *counts)
        .select(*key, "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), *["n_near"] * len(counts))
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no item window occurs."""
    hit = materialize(
        contamination(docs, benchmark, window, keyed=True, slop=None).filter("contaminated").select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct(), "contaminated"
    )
    # the caller's columns travel in one, so none of their names can clash
    rows = docs.select(F.struct("*").alias("row"))
    text_hash, doc_id = F.xxhash64(F.col("row")["text"].cast("string")), F.col("row")["doc_id"].cast("long")
    marked = KeyBitmap(hit, F.xxhash64("hit_hash", "hit_id")).mark(rows, F.xxhash64(text_hash, doc_id), "doubtful")
    doubtful = marked.filter("doubtful").join(hit, (text_hash == F.col("hit_hash")) & doc_id.eqNullSafe(F.col("hit_id")), "left_anti")
    return marked.filter("not doubtful").select("row").unionByName(doubtful.select("row")).select("row.*")


CONTAMINATION_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS p
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s FROM iw WHERE len(w) > 0)
), dwin AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, item_id, k, s FROM dwin JOIN win USING (k, p)
), spots AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, s + unnest(generate_series(0, k - 1)) AS spot FROM hits) GROUP BY doc_id
), ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
), tokens AS (
  SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM dw
), places AS (
  SELECT item_id, least(10, len(w)) AS k, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS j FROM iw WHERE len(w) > 0
), covered AS (
  SELECT DISTINCT doc_id, item_id, k, j, pos - j + unnest(generate_series(-3, 3)) AS shift FROM tokens JOIN places USING (term)
), runs AS (
  SELECT doc_id, item_id, k, shift, j - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY j) AS run FROM covered
), near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM (SELECT doc_id, item_id FROM runs GROUP BY doc_id, item_id, k, shift, run HAVING count(*) >= k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM dw LEFT JOIN spots USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN near USING (doc_id)
"""
