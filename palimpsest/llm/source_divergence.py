"""Divergence of sources within a language, from term counts in DuckDB shards.

Three passes run vectorised SQL in DuckDB inside Spark's tasks; Spark shuffles between them and
merges what they return.

* Counts.  Each slice of a scan task is split into terms and counted per language, source and
  term, with the number of documents.  Spark adds the slices up.
* Shards.  The counts are dealt by hash of language and term, sorted, and read in chunks that
  end between terms, so a chunk holds all sources of its terms and memory does not depend on the
  shard's size.  SQL keeps the terms of enough documents, with their counts per source and per
  language.
* Pair sums.  With the totals of sources at hand, SQL sums per shard what two sources that both
  use a term differ from the floor, and how many terms of a source have a given count.

A pair's sum over all kept terms needs no dense table: a term that neither source uses adds the
same value for each such term; one that only one of them uses adds a value that depends on its
count alone; only terms of both need the pair.  With ``f`` of the two smoothed shares, ``0`` for
a source's share of a term it does not use::

    sum f(p, q) = V f(0, 0) + sum [f(p, 0) - f(0, 0)] + sum [f(0, q) - f(0, 0)]
                  + sum over terms of both [f(p, q) - f(p, 0) - f(0, q) + f(0, 0)]

Everything is integer arithmetic; products that may exceed 64 bits are 128 bits wide.

Defined results.  Null texts, languages and sources are empty strings.  Every row of ``docs`` is
a document, repeated rows too.  A group without terms, or in a language that keeps none, still
has its pairs.  A language of one source has no pairs.  An empty table has no rows.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import discard, materialize

LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Bytes of text per slice that is counted at once, and rows of a chunk of a shard; they change no result.
SLICE_BYTES, CHUNK_ROWS = 16_000_000, 400_000

#: A-Z become a-z, other ASCII that is no letter becomes a blank, all else stays.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))

COUNT_SQL = """
WITH spread AS (SELECT nth, lang, source, unnest(string_split(body, ' ')) AS term FROM docs),
per_doc AS (SELECT nth, lang, source, term, count(*) AS n FROM spread WHERE term <> '' GROUP BY ALL)
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS d FROM per_doc GROUP BY ALL
UNION ALL
SELECT lang, source, NULL, 0, count(*) FROM docs GROUP BY ALL
"""

KEEP_SQL = """
WITH kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM shard GROUP BY ALL HAVING sum(d) >= {least})
SELECT lang, source, term, shard.n AS n FROM shard JOIN kept USING (lang, term)
UNION ALL
SELECT lang, NULL, term, n FROM kept
"""

PAIR_SQL = """
WITH met AS (
  SELECT a.lang, a.source, b.source AS other, a.p, a.zero AS p0, b.p AS q, b.zero AS q0
  FROM shard a JOIN shard b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source
)
SELECT lang, source, other, CAST(NULL AS BIGINT) AS n,
       CAST(sum((p - q) * (p - q) // (p + q) - (p - q0) * (p - q0) // (p + q0) - (p0 - q) * (p0 - q) // (p0 + q) + (p0 - q0) * (p0 - q0) // (p0 + q0)) AS BIGINT) AS value
FROM met GROUP BY ALL
UNION ALL
SELECT lang, source, NULL, n, count(*) FROM shard GROUP BY ALL
"""


def _engine():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})


def _folded(texts: pa.Array) -> pa.Array:
    """The texts with terms in lower case and blanks between them; lengths in bytes stay."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    body = pa.py_buffer(data.to_pybytes().translate(_FOLD)) if data is not None else None
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, offsets, body], offset=texts.offset)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about SLICE_BYTES of text, a longer text alone."""
    size = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text").cast(pa.large_binary())])
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + SLICE_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _engine()
    for batch in batches:
        for part in _slices(batch):
            # a copy of the slice alone, so the fold does not touch the whole batch
            part = pa.Table.from_batches([part]).take(pa.array(range(part.num_rows)))
            docs = pa.table({"nth": pa.array(range(part.num_rows), pa.int64()), "lang": part.column("lang"), "source": part.column("source"), "body": _folded(part.column("text").combine_chunks())})
            con.register("docs", docs)
            yield from con.sql(COUNT_SQL).to_arrow_table().cast(_COUNTED).to_batches()
            con.unregister("docs")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A sorted stream in chunks that end between two terms."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= CHUNK_ROWS:
            last = [held[-1].column(c)[-1].as_py() for c in ("lang", "term")]
            lang, term = (batch.column(c).to_pylist() for c in ("lang", "term"))
            cut = next((i for i in range(len(term)) if [lang[i], term[i]] != last), len(term))
            held.append(batch.slice(0, cut))
            batch = batch.slice(cut)
            if not batch.num_rows:
                continue
            yield pa.Table.from_batches(held)
            held, rows = [], 0
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _per_shard(sql: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        for chunk in _chunks(batches):
            con.register("shard", chunk)
            yield from con.sql(sql).to_arrow_table().cast(schema).to_batches()
            con.unregister("shard")

    return run


_TEXT, _LONG = pa.string(), pa.int64()
_COUNTED = pa.schema([("lang", _TEXT), ("source", _TEXT), ("term", _TEXT), ("n", _LONG), ("d", _LONG)])
_KEPT = pa.schema([("lang", _TEXT), ("source", _TEXT), ("term", _TEXT), ("n", _LONG)])
_PAIRS = pa.schema([("lang", _TEXT), ("source", _TEXT), ("other", _TEXT), ("n", _LONG), ("value", _LONG)])


def _in_shards(rows: DataFrame) -> DataFrame:
    return rows.repartition("lang", "term").sortWithinPartitions("lang", "term")


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * terms))``."""
    wide = lambda c: c.cast("decimal(20,0)")
    below = F.greatest(total + 2 * terms, F.lit(1))
    return (1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 2), wide(below))).cast("long")


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q) ** 2 / (p + q))``; shares are at most SCALE + 1, so 64 bits hold the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, d)``: occurrences and documents; ``term`` null: the group's documents."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    plain = docs.select(name("lang"), name("source"), F.col("text").cast("string").alias("text"))
    counted = plain.mapInArrow(_count, "lang string, source string, term string, n long, d long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: pairs of sources, and the ``top`` terms of each source.

    A language keeps the terms of ``least_docs`` of its documents or more.
    """
    counts = materialize(term_counts(docs), "term_counts")
    shards = _in_shards(counts.filter("term is not null")).mapInArrow(_per_shard(KEEP_SQL.format(least=int(least_docs)), _KEPT), "lang string, source string, term string, n long")
    kept = materialize(shards, "kept_terms")
    of_lang = kept.filter("source is null").groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    of_source = kept.filter("source is not null").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    no = F.lit(0).cast("long")
    found = counts.filter("term is null").select("lang", "source").join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    totals = found.select("lang", "source", *[F.coalesce(c, no).alias(c) for c in ("total", "terms", "lang_total")])
    groups = materialize(totals.withColumn("zero", share(no, F.col("total"), F.col("terms"))), "divergence_groups")
    discard(counts)

    used = kept.filter("source is not null").join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    merged = _in_shards(used.select("lang", "source", "term", "n", "p", "zero")).mapInArrow(_per_shard(PAIR_SQL, _PAIRS), "lang string, source string, other string, n long, value long")
    sums = materialize(merged.groupBy("lang", "source", "other", "n").agg(F.sum("value").alias("value")), "pair_sums")

    mine = groups.select("lang", "source", "zero", "terms", "total")
    theirs = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("zero_o"))
    floor = gap(F.col("zero"), F.col("zero_o"))
    # terms of one source against another's share of a term it does not use, by count
    steps = sums.filter("n is not null").select("lang", "source", "n", F.col("value").alias("times")).join(mine, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    one_sided = steps.join(theirs, (steps["lang"] == theirs["lang"]) & (steps["source"] != theirs["other"])).select(
        steps["lang"], "source", "other", (F.col("times") * (gap(F.col("p"), F.col("zero_o")) - floor)).alias("value")
    )
    flat = mine.join(theirs, (mine["lang"] == theirs["lang"]) & (mine["source"] != theirs["other"])).select(mine["lang"], "source", "other", (F.col("terms") * floor).alias("value"))
    turned = lambda df: df.unionByName(df.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    shared = sums.filter("n is null").select("lang", "source", "other", "value")
    # flat has both directions; what one side or a shared term adds counts for both
    pairs = flat.unionByName(turned(one_sided)).unionByName(turned(shared)).groupBy("lang", "source", "other").agg(F.sum("value").cast("long").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair_part = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(by_value))

    overall = kept.filter("source is null").join(groups.select("lang", "terms", "lang_total").distinct(), "lang").select("lang", "term", share(F.col("n"), F.col("lang_total"), F.col("terms")).alias("q"))
    marked = used.select("lang", "source", "term", "p").join(overall, ["lang", "term"]).filter("p > q")
    term_part = marked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    return pair_part.unionByName(term_part).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS nth, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
), spread AS (
  SELECT nth, lang, source, unnest(string_split_regex(body, '[\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), counted AS (
  SELECT nth, lang, source, term, count(*) AS n FROM spread WHERE term <> '' GROUP BY ALL
), kept AS (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM counted GROUP BY ALL HAVING count(*) >= 10
), sizes AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), uses AS (
  SELECT lang, source, term, CAST(sum(c.n) AS HUGEINT) AS n FROM counted c JOIN kept k USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce((SELECT sum(u.n) FROM uses u WHERE u.lang = groups.lang AND u.source = groups.source), 0) AS total FROM groups LEFT JOIN sizes USING (lang)
), shares AS (
  SELECT t.lang, t.source, k.term, coalesce(u.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(u.n, 0) + 2) // (t.total + 2 * t.v) AS HUGEINT) AS p
  FROM totals t JOIN kept k ON t.lang = k.lang LEFT JOIN uses u ON u.lang = t.lang AND u.source = t.source AND u.term = k.term
), langs AS (
  SELECT k.lang, k.term, CAST(1 + 1000000000 * (k.n + 2) // (s.total + 2 * s.v) AS HUGEINT) AS q FROM kept k JOIN sizes s USING (lang)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
  FROM shares s JOIN langs l ON s.lang = l.lang AND s.term = l.term WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
