"""Glossary mining, segmentation of compounds, and searches with expansion."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import has_cjk, ngram_words, word_ngrams
from .prefilter import KeyBitmap
from .rules import compile_rule

#: Words that neither start nor end a mined phrase, and the evidence that activates a term.
STOP_WORDS = ("a", "an", "and", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with", "study", "trial", "patients", "clinical")
EVIDENCE = 2
#: Characters of a mined phrase, as in ``word_ngrams``.
SHORTEST, LONGEST = 3, 60
#: Sizes of work that change no result: words of a slice, characters of text whose phrases are one bucket.  An odd factor of hashes.
SLICE_WORDS, BUCKET_CHARS, FOLD = 2_000_000, 5_000_000, 0x9E3779B97F4A7C15


def sibling_pairs(records: DataFrame, entity: str, record: str, title: str) -> DataFrame:
    """``(zh_title, en_title, record)``: titles of one entity in both languages."""
    zh = records.filter(has_cjk(F.col(title))).select(entity, F.col(title).alias("zh_title"), F.col(record).alias("zh_record"))
    en = records.filter(F.col(title).rlike("[a-zA-Z]") & ~has_cjk(F.col(title))).select(entity, F.col(title).alias("en_title"), record)
    return zh.join(en, entity).filter(F.col("zh_record") != F.col(record)).select("zh_title", "en_title", record)


def mine_phrases(texts: DataFrame, key: str, text: Column, low: int = 1, high: int = 4, stop: Sequence[str] = STOP_WORDS, least: int = EVIDENCE) -> DataFrame:
    """``(phrase, n_texts)``: n-grams of at least ``least`` texts; repetition within a text counts once.

    Rows of keys that no other row has are counted by slices; those that may share their key (a bounded
    bitmap says so) by phrase and key.  A slice's phrases are dealt to buckets by their hash and shuffled as
    compressed Arrow batches, a row per bucket; a bucket holds what ``BUCKET_CHARS`` of text give, and is added up
    at once.
    """
    held = texts.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), text.alias("t"))
    several = held.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = (held.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0) // BUCKET_CHARS + 1
    if several.isEmpty():
        counts = _slice_counts(held, buckets, low, high, stop)
    else:
        hashed = F.xxhash64("key")
        marked = KeyBitmap(several, hashed).mark(held, hashed)
        shared = marked.filter(F.coalesce("maybe", F.lit(False))).select("key", F.explode(word_ngrams(F.col("t"), low, high, stop)).alias("phrase")).distinct()
        lone = _slice_counts(marked.filter(~F.coalesce("maybe", F.lit(False))), buckets, low, high, stop)
        counts = lone.unionByName(_dealt(shared.groupBy("phrase").agg(F.count("*").alias("n")), buckets))

    def add(bucket: pa.Table) -> pa.Table:
        found = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in bucket.column("phrases").combine_chunks()])
        each = found.column("phrase").combine_chunks().dictionary_encode()
        total = np.zeros(len(each.dictionary), np.int64)
        np.add.at(total, each.indices.to_numpy(), found.column("n").to_numpy())
        enough = np.flatnonzero(total >= least)
        return pa.table({"phrase": each.dictionary.take(pa.array(enough)).cast(pa.string()), "n_texts": total[enough]})

    return counts.groupBy("bucket").applyInArrow(add, "phrase string, n_texts long")


def _slice_counts(rows: DataFrame, buckets: int, low: int, high: int, stop: Sequence[str]) -> DataFrame:
    """``(bucket, phrases)``: the n-grams of slices of ``t`` with the number of the slice's rows that hold them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lists in _slices_of_words(batch.column(0)):
                yield from _packed(list(_count_grams(lists, low, high, stop, LONGEST)), buckets)

    return rows.select(ngram_words(F.col("t")).alias("w")).filter("size(w) > 0").mapInArrow(count, "bucket long, phrases binary")


def _dealt(counts: DataFrame, buckets: int) -> DataFrame:
    """``(phrase, n)`` in the form of ``_slice_counts``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phrases = batch.column(0).cast(pa.large_string())
            hashes = np.array([reduce(_fold, (crc32(w.encode()) for w in p.split(" "))) for p in phrases.to_pylist()], dtype=np.uint64)
            yield from _packed([(phrases, batch.column(1), hashes)], buckets)

    return counts.mapInArrow(deal, "bucket long, phrases binary")


def _fold(h: int, word: int) -> int:
    """The hash of an n-gram and a further word's."""
    return (h * FOLD + word) & (2**64 - 1)


def _packed(parts: Sequence[tuple[pa.Array, pa.Array, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Phrases, numbers and hashes as a compressed batch per bucket."""
    if not parts:
        return
    hashes = np.concatenate([h for _, _, h in parts])
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(FOLD)
    bucket = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    table = pa.table({"phrase": pa.chunked_array([p for p, _, _ in parts]).combine_chunks(), "n": pa.chunked_array([n for _, n, _ in parts]).combine_chunks()}).take(pa.array(order)).combine_chunks()
    bucket = bucket[order]
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
    packed, start = [], 0
    for end in ends:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table.slice(start, end - start))
        packed.append(sink.getvalue().to_pybytes())
        start = end
    yield pa.RecordBatch.from_arrays([pa.array(bucket[ends - 1]), pa.array(packed, pa.binary())], names=["bucket", "phrases"])


def _slices_of_words(lists: pa.Array) -> Iterator[pa.Array]:
    """Runs of whole texts of about ``SLICE_WORDS`` words; a longer text is one."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64))
    start = 0
    while start < len(lists):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_WORDS, "right")))
        yield lists.slice(start, stop - start)
        start = stop


def _count_grams(lists: pa.Array, low: int, high: int, stop: Sequence[str], longest: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Distinct n-grams of a slice, the number of its texts that hold them, and hashes; numbered from those of ``n - 1`` words."""
    words = lists.flatten().cast(pa.large_string()).dictionary_encode()
    known = words.dictionary
    ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    doc = np.repeat(np.arange(len(lists), dtype=np.int32), sizes)
    width = np.asarray(pc.utf8_length(known), dtype=np.int64)
    allowed = ~np.asarray(pc.is_in(known, value_set=pa.array(stop, pa.large_string())), dtype=bool)
    marks = np.array([crc32(w.encode()) for w in known.to_pylist()], dtype=np.uint64)
    good = allowed[ids]
    at = np.flatnonzero(good)  # where an n-gram begins
    code = ids[at]
    chars = width[code]
    for n in range(1, high + 1):
        if n > 1:
            more = at + n - 1 < len(ids)
            at, code, chars = at[more], code[more], chars[more]
            last = at + n - 1
            more = good[last] & (doc[at] == doc[last])
            at, code, chars, last = at[more], code[more], chars[more], last[more]
            code = code * len(known) + ids[last]
            chars = chars + 1 + width[ids[last]]
        # a longer n-gram is no shorter
        short = chars <= longest
        at, code, chars = at[short], code[short], chars[short]
        if not len(at):
            return
        order = np.argsort(code, kind="stable")
        by_code, by_doc = code[order], doc[at[order]]
        first = np.concatenate(([True], by_code[1:] != by_code[:-1]))
        fresh = first.copy()
        fresh[1:] |= by_doc[1:] != by_doc[:-1]
        starts = np.flatnonzero(first)
        code = np.empty(len(at), np.int64)
        code[order] = np.cumsum(first) - 1
        if n < low:
            continue
        held = np.add.reduceat(fresh.astype(np.int64), starts)
        spot = order[starts]
        long_enough = chars[spot] >= SHORTEST
        spot, held = at[spot[long_enough]], held[long_enough]
        if len(spot):
            hashes = marks[ids[spot]]
            for k in range(1, n):
                hashes = hashes * np.uint64(FOLD) + marks[ids[spot + k]]
            phrase = pc.binary_join_element_wise(*[known.take(pa.array(ids[spot + k])) for k in range(n)], pa.scalar(" ", pa.large_string()))
            yield phrase, pa.array(held), hashes


@F.pandas_udf(StringType())
def common_substring(texts: pd.Series) -> pd.Series:
    """Longest substring (two characters at least) of all texts of a list; the first of the shortest text."""

    def longest(items) -> str | None:
        items = [x for x in items if x]
        if not items:
            return None
        short = min(items, key=len)
        for width in range(len(short), 1, -1):
            for start in range(len(short) - width + 1):
                if all(short[start : start + width] in t for t in items):
                    return short[start : start + width]
        return None

    return texts.map(longest)


def learn(glossary: DataFrame, mined: DataFrame) -> DataFrame:
    """Glossary after new evidence: ``(zh_term, en_term, evidence, status)``; evidence adds up."""
    both = glossary.select("zh_term", "en_term", "evidence").unionByName(mined.select("zh_term", "en_term", "evidence"))
    total = both.groupBy("zh_term", "en_term").agg(F.sum("evidence").alias("evidence"))
    return total.withColumn("status", F.when(F.col("evidence") >= EVIDENCE, "active").otherwise("candidate"))


def lookup(terms: Mapping[str, str], text: str) -> str | None:
    """Translation either way, by the exact lower-cased term."""
    key = text.strip().lower()
    backward = {}
    for zh, en in terms.items():
        backward.setdefault(en.lower(), zh)
    return {zh.lower(): en for zh, en in terms.items()}.get(key) or backward.get(key)


def segment(compound: str, vocabulary: Sequence[str], low: int = 2, high: int = 4) -> list[str] | None:
    """2 to 4 known parts that cover the compound, longest first from the left; else None."""
    known = sorted({v for v in vocabulary if v}, key=lambda v: (-len(v), v))
    parts, rest = [], compound
    while rest:
        part = next((v for v in known if rest.startswith(v)), None)
        if part is None or len(parts) == high:
            return None
        parts.append(part)
        rest = rest[len(part) :]
    return parts if low <= len(parts) <= high else None


def expanded_search(df: DataFrame, rules: Mapping, columns: Mapping, terms: Mapping[str, str], vocabulary: Sequence[str] = ()) -> DataFrame:
    """Rows of the rules, of their translation, or of the segments of a compound, with their branch.

    All branches are one filter and one scan; ``branch`` is the first that matches.
    """
    query = rules.get("query")
    text = query if isinstance(query, str) else " ".join(query or [])
    branches = [("base", compile_rule(rules, columns))]
    translated = lookup(terms, text) if text else None
    if translated:
        branches.append(("translated", compile_rule({**rules, "query": translated}, columns)))
    parts = segment(text, vocabulary) if text else None
    if parts:
        branches.append(("segments", compile_rule({**rules, "query": " ".join(parts)}, columns)))
    which = F.lit(None).cast("string")
    for name, predicate in reversed(branches):
        which = F.when(predicate, name).otherwise(which)
    return df.withColumn("branch", which).filter("branch is not null")


def learned_translation(glossary: DataFrame, text: str) -> str | None:
    """The translation either way of an active learned term: that of most evidence, then the smallest."""
    low = F.lit(text.strip().lower())
    rows = glossary.filter("status = 'active'")
    both = rows.select(F.lower("zh_term").alias("t"), F.col("en_term").alias("other"), "evidence").unionByName(rows.select(F.lower("en_term").alias("t"), F.col("zh_term").alias("other"), "evidence"))
    best = both.filter(F.col("t") == low).orderBy(F.desc("evidence"), "other").limit(1).collect()
    return best[0]["other"] if best else None


def retire(glossary: DataFrame, terms: DataFrame) -> DataFrame:
    """The glossary with the given pairs ``(zh_term, en_term)`` retired: they translate nothing, whatever evidence follows."""
    gone = terms.select("zh_term", "en_term", F.lit(True).alias("gone")).distinct()
    return glossary.join(gone, ["zh_term", "en_term"], "left").withColumn("status", F.when(F.col("gone"), "retired").otherwise(F.col("status"))).drop("gone")


def search_with_fallback(df: DataFrame, rules: Mapping, columns: Mapping, terms: Mapping[str, str], vocabulary: Sequence[str] = (), learned: DataFrame | None = None) -> DataFrame:
    """Rows with their ``branch``: the rules themselves, their translation, and, where these have no row at all, the segments of a compound.

    A learned translation goes before the given ones.  One scan marks all branches; whether the first two
    have a row is a join with one row at most.
    """
    query = rules.get("query")
    text = query if isinstance(query, str) else " ".join(query or [])
    other = (learned_translation(learned, text) if learned is not None and text else None) or (lookup(terms, text) if text else None)
    marked = expanded_search(df, rules, columns, {text: other} if other else {}, vocabulary)
    direct = marked.filter("branch <> 'segments'")
    some = direct.select(F.lit(True).alias("found")).limit(1)
    return direct.unionByName(marked.filter("branch = 'segments'").join(F.broadcast(some), F.col("found"), "left_anti"))


def search_totals(df: DataFrame, rules: Mapping, columns: Mapping, terms: Mapping[str, str], vocabulary: Sequence[str] = (), learned: DataFrame | None = None) -> DataFrame:
    """``(total, unfiltered_total)``: rows of the search, and of its query without the other rules."""
    count = lambda r, name: search_with_fallback(df, r, columns, terms, vocabulary, learned).agg(F.count("*").alias(name)).withColumn("one", F.lit(1))
    return count(rules, "total").join(count({"query": rules.get("query")}, "unfiltered_total"), "one").drop("one")
