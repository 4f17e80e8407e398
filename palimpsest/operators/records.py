"""Record operators of reports, feeds, searches and ingestion bookkeeping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.text import has_cjk, keywords_found, trigrams

#: Prefix of an id, and the registry and region it comes from.
ORIGINS = (("NCT", "ClinicalTrials.gov", "United States"), ("ChiCTR", "ChiCTR", "China"), ("CTR", "CTR", "China"), ("ISRCTN", "ISRCTN", "United Kingdom"), ("ACTRN", "ANZCTR", "Australia"), ("JPRN", "JPRN", "Japan"), ("EUCTR", "EUCTR", "Europe"), ("DRKS", "DRKS", "Germany"))


def id_origin(value: Column) -> Column:
    """Struct of registry and jurisdiction by an id's prefix."""
    out = F.lit(None).cast("struct<registry:string,jurisdiction:string>")
    for prefix, registry, place in reversed(ORIGINS):
        out = F.when(F.upper(value).startswith(prefix.upper()), F.struct(F.lit(registry).alias("registry"), F.lit(place).alias("jurisdiction"))).otherwise(out)
    return out


def native_or_mirror(source: Column, value: Column, aggregator: str, primary: str) -> Column:
    """The aggregator's own records apart from those it mirrors from a primary registry."""
    return F.when(source != aggregator, source).when(F.upper(value).startswith(primary.upper()), f"{aggregator}_{primary}").otherwise(f"{aggregator}_native")


def report_groups(records: DataFrame, group: Column, large: int = 100) -> DataFrame:
    """``(section, n, layout)``: a section per group, as one card where it is large."""
    return records.groupBy(group.alias("section")).agg(F.count("*").alias("n")).withColumn("layout", F.when(F.col("n") > large, "card").otherwise("list"))


def sites(text: Column) -> Column:
    """Structs of facility, city and country from JSON objects or ``a, b, c`` lines."""
    objects = F.from_json(text, "array<struct<facility:string,city:string,country:string>>")
    lines = F.filter(F.split(text, r"[;\n]"), lambda x: F.trim(x) != "")
    parts = lambda x: let(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda a: F.struct(a[0].alias("facility"), F.when(F.size(a) > 2, F.try_element_at(a, F.lit(-2))).alias("city"), F.when(F.size(a) > 1, F.try_element_at(a, F.lit(-1))).alias("country")))
    return F.coalesce(objects, F.transform(lines, parts))


def site_countries(site_list: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(site_list, lambda s: s["country"]), lambda c: c.isNotNull())))


def investigator(payload: Column, path: str = "$.officials") -> Column:
    """The principal investigator of a payload, else its first official."""
    people = F.from_json(F.get_json_object(payload, path), "array<struct<name:string,role:string>>")
    leads = F.filter(people, lambda p: F.upper(p["role"]).contains("PRINCIPAL"))
    return F.coalesce(F.try_element_at(leads, F.lit(1))["name"], F.try_element_at(people, F.lit(1))["name"])


def numbered_rows(text: Column) -> Column:
    """Rows of a flattened table whose rows start with a line of a bare integer."""
    blocks = F.filter(F.split(text, r"(?m)^\s*\d+\s*$\n?"), lambda b: F.trim(b) != "")
    return F.transform(blocks, lambda b: F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x != ""))


def wrap_legacy_list(text: Column) -> Column:
    """JSON array text as it is; any other text as the array of its parts."""
    parts = F.filter(F.transform(F.split(text, r"[;\n]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.from_json(text, "array<string>").isNotNull() & F.trim(text).startswith("["), text).when(F.size(parts) > 0, F.to_json(parts))


def labelled_values(events: DataFrame, labels: Mapping[str, str], field: str = "status_id") -> DataFrame:
    """Old and new values of one field as labels; unknown keys stay."""
    names = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    label = lambda c: F.when(F.col("field_name") == field, F.coalesce(F.element_at(names, F.col(c)), F.col(c))).otherwise(F.col(c))
    return events.withColumns({"old_value": label("old_value"), "new_value": label("new_value")})


def translate_terms(text: Column, terms: Mapping[str, str]) -> Column:
    """Known terms replaced, longest first."""
    out = text
    for term, other in sorted(terms.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        out = F.replace(out, F.lit(term), F.lit(other))
    return out


def trigram_postings(records: DataFrame, key: str, text: Column) -> DataFrame:
    """``(gram, key)``: an index that only speeds up ``trigram_search``."""
    return records.select(F.explode(trigrams(text)).alias("gram"), key)


def trigram_search(records: DataFrame, postings: DataFrame, key: str, text: Column, phrase: str) -> DataFrame:
    """Records that contain the phrase, by its trigrams and a check; short phrases are scanned."""
    low = phrase.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    hit = F.lower(text).contains(low)
    if not grams:
        return records.filter(hit)
    found = postings.filter(F.col("gram").isin(grams)).groupBy(key).agg(F.count_distinct("gram").alias("__n")).filter(F.col("__n") == len(grams))
    return records.join(found.select(key), key, "left_semi").filter(hit)


def query_intent(text: str, sponsors: Sequence[str] = ()) -> str:
    """``sponsor``, ``condition`` or ``text``: where a search term belongs."""
    low = text.strip().lower()
    if low in {s.lower() for s in sponsors} or any(m in low for m in ("inc", "ltd", "pharma", "university", "hospital", "公司", "医院", "大学")):
        return "sponsor"
    if any(m in low for m in ("cancer", "disease", "syndrome", "carcinoma", "itis", "病", "癌", "炎", "综合征")):
        return "condition"
    return "text"


def first_of_chain(version: Column, latest: Column, bootstrap: Column) -> Column:
    """A record that is new: first version, latest, and not of the initial load."""
    return (version == 1) & latest & ~bootstrap


def mixed_language_pairs(records: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """Pairs ``a < b`` of one group of which one text is CJK and the other is not.

    Every pair is a result; the smaller language of a group decides their number.
    """
    r = records.select(group, F.col(key).alias("k"), has_cjk(F.col(text)).alias("cjk"))
    a, b = r.filter("cjk").select(group, F.col("k").alias("x")), r.filter("not cjk").select(group, F.col("k").alias("y"))
    return a.join(b, group).select(group, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def snapshot_diff(snapshot: DataFrame, library: DataFrame, key: str) -> DataFrame:
    """Keys of a snapshot, once each, that the library lacks."""
    return snapshot.select(key).distinct().join(library.select(key), key, "left_anti")


def list_activity(rows: DataFrame, items: Column, entity: str, conditions: Mapping[str, Column], k: int) -> DataFrame:
    """Distinct entities per list item (a sponsor, say) that meet each condition; the top ``k``."""
    exploded = rows.withColumn("item", F.explode(items))
    out = exploded.groupBy("item").agg(*[F.count_distinct(F.when(c, F.col(entity))).alias(n) for n, c in conditions.items()])
    return out.orderBy(*[F.desc(n) for n in conditions], "item").limit(k)


def period_counts(events: DataFrame, ts: str, as_of: str, hours: Sequence[int], conditions: Mapping[str, Column]) -> DataFrame:
    """A row per period before ``as_of``: how many rows meet each condition."""
    end = F.lit(as_of).cast("timestamp_ntz")
    inside = lambda h: F.col(ts) >= end - F.expr(f"interval {h} hours")
    one = [F.struct(F.lit(h).alias("hours"), *[F.count_if(inside(h) & c).alias(n) for n, c in conditions.items()]) for h in hours]
    return events.agg(F.array(*one).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def daily_view(events: DataFrame, ts: str, entity: str, item: Column) -> DataFrame:
    """``(day, entity, n_changes, items)``: what changed on a day, in order."""
    return events.groupBy(F.to_date(ts).alias("day"), entity).agg(F.count("*").alias("n_changes"), F.array_join(F.array_sort(F.collect_list(item)), ",").alias("items"))


def watch_keywords(docs: DataFrame, key: str, text: Column, keywords: Sequence[str], recent: Column, first: int = 5, salts: int = 64) -> DataFrame:
    """Per keyword: documents, recent ones, and the first ids; one pass over the texts.

    The first ids are ranked within ``salts`` parts of a keyword, then among the parts' first ones.
    """
    rows = docs.select(F.col(key).alias("id"), recent.alias("recent"), F.explode(keywords_found(text, keywords)).alias("keyword"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    ranked = salted.withColumn("n", F.row_number().over(Window.partitionBy("keyword", "salt").orderBy("id")))
    parts = ranked.groupBy("keyword", "salt").agg(F.count("*").alias("total"), F.count_if("recent").alias("recent"), F.collect_list(F.when(F.col("n") <= first, F.col("id"))).alias("ids"))
    ids = F.array_join(F.transform(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, first), lambda x: x.cast("string")), ",")
    return parts.groupBy("keyword").agg(F.sum("total").alias("total"), F.sum("recent").alias("recent"), ids.alias("first_ids"))


def segment_ranking(records: DataFrame, key: str, text: Column, parts: Sequence[str]) -> DataFrame:
    """Records of any part, those of all parts first: adds ``rank_all`` and ``first_part``."""
    low = F.lower(text)
    hit = [low.contains(p.lower()) for p in parts]
    first = reduce(lambda out, kv: F.when(kv[1], kv[0]).otherwise(out), reversed(list(enumerate(hit))), F.lit(len(parts)))
    every, some = reduce(lambda a, b: a & b, hit), reduce(lambda a, b: a | b, hit)
    return records.filter(some).withColumns({"all_parts": every, "first_part": first}).orderBy(F.desc("all_parts"), "first_part", key)


def backfill(column: Column, patterns: Sequence[tuple[str, str]], text: Column) -> Column:
    """The known value, else that of the first pattern the text contains."""
    out = F.lit(None).cast("string")
    for pattern, value in reversed(list(patterns)):
        out = F.when(text.contains(pattern), value).otherwise(out)
    return F.coalesce(column, out)


def refresh_plan(records: DataFrame, queue: DataFrame, key: str, crawled: str, n: int) -> DataFrame:
    """The ``n`` records crawled longest ago that are not queued already."""
    open_items = queue.filter(F.col("state").isin("pending", "running")).select(key)
    return records.join(open_items, key, "left_anti").orderBy(F.asc_nulls_first(crawled), key).limit(n)


def seen_pages(pages: DataFrame, known: DataFrame, walk: str, page: str, key: str, stop: int = 2) -> DataFrame:
    """Rows of a newest-first walk up to the page that ends ``stop`` fully known pages in a row."""
    rows = pages.join(known.select(key).distinct().withColumn("__known", F.lit(1)), key, "left")
    per = rows.groupBy(walk, page).agg(F.min(F.coalesce("__known", F.lit(0))).alias("full"))
    w = Window.partitionBy(walk).orderBy(page)
    recent = F.sum("full").over(w.rowsBetween(-(stop - 1), 0)) == stop
    ended = per.withColumn("end", F.when(recent, F.col(page))).groupBy(walk).agg(F.min("end").alias("end"))
    return pages.join(ended, walk).filter(F.col("end").isNull() | (F.col(page) <= F.col("end"))).drop("end")


def finish_run(runs: DataFrame, run: str, succeeded: bool, cursor: str | None) -> DataFrame:
    """A run's row closed: the cursor moves only on success and on a non-empty answer."""
    mine = (F.col("run_id") == run) & (F.col("status") == "running")
    return runs.withColumns({"cursor_after": F.when(mine & F.lit(succeeded and cursor is not None), F.lit(cursor)).when(mine, F.col("cursor_before")).otherwise(F.col("cursor_after")), "status": F.when(mine, "completed" if succeeded else "failed").otherwise(F.col("status"))})
