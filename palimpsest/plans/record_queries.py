"""Queries of reports, feeds and bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import records
from .base import query, table


@query("""SELECT item, count(DISTINCT p_partkey) AS parts, count(DISTINCT CASE WHEN p_size > 25 THEN p_partkey END) AS large
FROM (SELECT p_partkey, p_size, unnest(string_split(p_name, ' ')) AS item FROM part) GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 8""")
def sponsor_activity(spark, sf_dir):
    return records.list_activity(table(spark, sf_dir, "part"), F.split("p_name", " "), "p_partkey", {"parts": F.lit(True), "large": F.col("p_size") > 25}, 8)


@query("""SELECT hours, count(*) FILTER (in_window) AS n, count(*) FILTER (in_window AND event_type = 'error') AS errors FROM (
SELECT h.hours, event_type, ts >= TIMESTAMP '2024-01-31 00:00:00' - h.hours * INTERVAL 1 HOUR AS in_window FROM events, (VALUES (48), (168)) h(hours)) GROUP BY hours""")
def periodic_counts(spark, sf_dir):
    return records.period_counts(table(spark, sf_dir, "events"), "ts", "2024-01-31 00:00:00", [48, 168], {"n": F.lit(True), "errors": F.col("event_type") == "error"})


@query("SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n_changes, string_agg(event_type, ',' ORDER BY event_type) AS items FROM events GROUP BY ALL")
def daily_view(spark, sf_dir):
    return records.daily_view(table(spark, sf_dir, "events"), "ts", "user_id", F.col("event_type"))


_WATCHED = ["idiot", "scum", "clown"]


@query(" UNION ALL ".join(f"""SELECT '{k}' AS keyword, count(*) AS total, count(*) FILTER (doc_id >= 900) AS recent, array_to_string(list_sort(list(doc_id))[1:5], ',') AS first_ids
FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}]){k}([^\\p{{L}}\\p{{N}}]|$)') HAVING count(*) > 0""" for k in _WATCHED))
def watch_keyword_totals(spark, sf_dir):
    return records.watch_keywords(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), _WATCHED, F.col("doc_id") >= 900)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed under')")
def trigram_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return records.trigram_search(docs, records.trigram_postings(docs, "doc_id", F.col("text")), "doc_id", F.col("text"), "licensed under").select("doc_id")


@query("SELECT page_id, coalesce(NULL, CASE WHEN contains(html, '<table') THEN 'table' WHEN contains(html, '<nav') THEN 'nav' END) AS kind FROM pages")
def backfill_kind(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", records.backfill(F.lit(None).cast("string"), [("<table", "table"), ("<nav", "nav")], F.col("html")).alias("kind"))


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY o_orderdate, o_orderkey LIMIT 30""")
def refresh_plan(spark, sf_dir):
    busy = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "pending").otherwise("done").alias("state"))
    o = table(spark, sf_dir, "orders")
    queued = o.join(busy, "o_custkey").select("o_orderkey", "state")
    return records.refresh_plan(o, queued, "o_orderkey", "o_orderdate", 30).select("o_orderkey", "o_orderdate")


@query("""SELECT p_partkey, contains(p_name, 'small') AND contains(p_name, 'ring') AS all_parts, CASE WHEN contains(p_name, 'small') THEN 0 ELSE 1 END AS first_part FROM part WHERE contains(p_name, 'small') OR contains(p_name, 'ring')""")
def segment_ranking(spark, sf_dir):
    return records.segment_ranking(table(spark, sf_dir, "part"), "p_partkey", F.col("p_name"), ["small", "ring"]).select("p_partkey", "all_parts", "first_part")


@query("SELECT section, count(*) AS n, CASE WHEN count(*) > 100 THEN 'card' ELSE 'list' END AS layout FROM (SELECT CASE WHEN lang <> 'en' THEN lang WHEN starts_with(upper(source), 'SRC1') THEN 'en_src1' ELSE 'en_native' END AS section FROM documents) GROUP BY 1")
def report_groups(spark, sf_dir):
    return records.report_groups(table(spark, sf_dir, "documents"), records.native_or_mirror(F.col("lang"), F.col("source"), "en", "src1"))


@query("SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def snapshot_diff(spark, sf_dir):
    snapshot = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return records.snapshot_diff(snapshot, table(spark, sf_dir, "part").filter("p_size > 10"), "p_partkey")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, substr(event_type, 1, 4) AS short_type FROM events")
def display_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tx.first_integer(F.get_json_object("props", "$.k")).alias("k"), F.substring("event_type", 1, 4).alias("short_type"))
