"""Queries of feeds, pages and summaries.

Projection: a user of ``events`` is an entity, a version is an event, its field changes are the
change events; customers carry the same ids, their nation is the registry, their region the
monitor, and customers of one segment are watched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, feeds, intel, resolve
from .base import query, table
from .event_queries import _PAIRS, field_changes

_CATEGORY = {"status_id": "status", "enrollment": "enrollment"}
_PLACED = _PAIRS + """, r AS (
  SELECT c_custkey AS user_id, n_name AS registry, r_name AS monitor, c_mktsegment = 'BUILDING' AS watched, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), e AS (
  SELECT k.*, registry, monitor, watched, CASE field_name WHEN 'status_id' THEN 'status' ELSE 'enrollment' END AS category FROM k JOIN r USING (user_id)
)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    placed = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return placed.select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("registry"), F.col("r_name").alias("monitor"), (F.col("c_mktsegment") == "BUILDING").alias("watched"), "c_acctbal")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_changes(spark, sf_dir).join(_records(spark, sf_dir).select("user_id", "registry"), "user_id")


@query(_PLACED + """SELECT 'total' AS section, '' AS name, NULL AS part, count(*) AS n, count(DISTINCT user_id) AS entities FROM e
UNION ALL SELECT 'registry', registry, NULL, count(*), count(DISTINCT user_id) FROM e GROUP BY registry
UNION ALL SELECT 'severity', severity, NULL, count(*), count(DISTINCT user_id) FROM e GROUP BY severity
UNION ALL SELECT 'category', category, NULL, count(*), count(DISTINCT user_id) FROM e GROUP BY category
UNION ALL SELECT 'trend', strftime(ts, '%Y-%m-%d'), severity, count(*), count(DISTINCT user_id) FROM e GROUP BY ALL""")
def update_feed_report(spark, sf_dir):
    return feeds.feed_report(_events(spark, sf_dir), "user_id", "ts", "registry", changes.field_category(F.col("field_name"), _CATEGORY))


@query(_PLACED + "SELECT event_id, field_name, user_id, registry, severity, watched, monitor AS monitors FROM e ORDER BY ts DESC, event_id DESC, field_name LIMIT 25")
def update_feed_page(spark, sf_dir):
    records = _records(spark, sf_dir)
    context = feeds.with_context(_events(spark, sf_dir), "user_id", records.filter("watched"), records.select("user_id", "monitor"), "monitor")
    page = feeds.update_feed(context, "user_id", "ts", "registry", F.col("field_name"), [F.desc("ts"), F.desc("event_id"), F.asc("field_name")])["page"]
    return page.select("event_id", "field_name", "user_id", "registry", "severity", "watched", "monitors")


@query(_PAIRS + "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, field_name) AS INTEGER) AS position, event_id, field_name, old_value, new_value FROM k")
def entity_history(spark, sf_dir):
    return feeds.history(field_changes(spark, sf_dir), "user_id", ["ts", "event_id", "field_name"]).select("user_id", "position", "event_id", "field_name", "old_value", "new_value")


@query(_PAIRS + """SELECT user_id, total, CAST(nth AS INTEGER) AS nth, event_id FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM k WHERE field_name = 'status_id') WHERE nth <= 10""")
def entity_change_page(spark, sf_dir):
    found = feeds.change_page(field_changes(spark, sf_dir), "user_id", [F.desc("ts"), F.desc("event_id")], F.col("field_name") == "status_id", 10)
    return found.select("user_id", "total", "nth", "event_id")


@query(_PAIRS + """SELECT v.event_id, v.user_id, count(k.event_id) AS change_count, CAST(max(CASE k.severity WHEN 'critical' THEN 4 WHEN 'important' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END) AS INTEGER) AS top_rank
FROM events v LEFT JOIN k USING (event_id) GROUP BY v.event_id, v.user_id""")
def version_list(spark, sf_dir):
    return feeds.version_list(table(spark, sf_dir, "events").select("event_id", "user_id"), field_changes(spark, sf_dir), "event_id")


_SINCE = "2024-01-24 00:00:00"


@query(_PLACED + f"""SELECT (SELECT count(DISTINCT user_id) FROM (SELECT user_id, min(ts) AS first FROM events GROUP BY 1) WHERE first >= TIMESTAMP '{_SINCE}') AS new_entities, count(DISTINCT user_id) AS updated_entities,
count(*) FILTER (severity IN ('critical', 'important')) AS important_changes, count(*) FILTER (watched) AS watched_updates FROM e WHERE ts >= TIMESTAMP '{_SINCE}'""")
def dashboard_summary(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first"))
    return feeds.dashboard(_events(spark, sf_dir), first, "user_id", "ts", "first", _records(spark, sf_dir).filter("watched"), _SINCE)


@query(_PLACED + f"""SELECT r.user_id, max(registry) AS sources, count(x.event_id) AS change_count, CAST(coalesce(max(CASE x.severity WHEN 'critical' THEN 4 WHEN 'important' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END) FILTER (x.event_id IS NOT NULL), 0) AS INTEGER) AS top_rank, max(x.ts) AS last_changed
FROM r LEFT JOIN (SELECT user_id, event_id, severity, ts FROM k WHERE ts >= TIMESTAMP '{_SINCE}') x USING (user_id) WHERE watched GROUP BY r.user_id""")
def watched_activity(spark, sf_dir):
    records = _records(spark, sf_dir)
    return feeds.watched_activity(records.filter("watched"), records, field_changes(spark, sf_dir), "user_id", "registry", "ts", _SINCE)


@query(_PLACED + f""", routes AS (SELECT registry, user_id FROM r WHERE watched UNION SELECT registry, user_id FROM r WHERE c_acctbal > 0),
z AS (SELECT registry, count(*) FILTER (ts >= TIMESTAMP '{_SINCE}' AND severity = 'critical') AS recent_critical, count(*) FILTER (ts >= TIMESTAMP '{_SINCE}' AND severity = 'important') AS recent_important, max(ts) AS last_activity FROM routes JOIN k USING (user_id) GROUP BY 1)
SELECT p.registry, coalesce((SELECT count(*) FROM r WHERE r.registry = p.registry AND watched), 0) AS trials, coalesce((SELECT count(*) FROM r WHERE r.registry = p.registry AND c_acctbal > 0), 0) AS matches, coalesce(recent_critical, 0) AS recent_critical, coalesce(recent_important, 0) AS recent_important, last_activity
FROM (SELECT n_name AS registry FROM nation) p LEFT JOIN z USING (registry)""")
def project_cards(spark, sf_dir):
    records, projects = _records(spark, sf_dir), table(spark, sf_dir, "nation").select(F.col("n_name").alias("registry"))
    trials, matches = records.filter("watched"), records.filter("c_acctbal > 0")
    return feeds.project_cards(projects, {"trials": trials, "matches": matches}, [trials, matches], field_changes(spark, sf_dir), "registry", "user_id", "ts", _SINCE)


_MOVED = "CASE WHEN c_acctbal < 0 THEN 'left' WHEN c_acctbal > 5000 THEN 'entered' ELSE 'reentered' END"


@query(_PLACED + f""", t AS (SELECT monitor, user_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'important') AS important FROM e GROUP BY ALL)
SELECT monitor, count(*) FILTER (c_acctbal >= 0) AS current_members, count(*) FILTER ({_MOVED} = 'entered') AS entered, count(*) FILTER ({_MOVED} = 'left') AS "left", count(*) FILTER ({_MOVED} = 'reentered') AS reentered,
coalesce((SELECT count(*) FROM t WHERE t.monitor = r.monitor), 0) AS changed_members, CAST(coalesce((SELECT sum(critical) FROM t WHERE t.monitor = r.monitor), 0) AS BIGINT) AS critical, CAST(coalesce((SELECT sum(important) FROM t WHERE t.monitor = r.monitor), 0) AS BIGINT) AS important FROM r GROUP BY monitor""")
def monitor_comparison(spark, sf_dir):
    records = _records(spark, sf_dir)
    members = records.select("monitor", "user_id", (F.col("c_acctbal") >= 0).alias("current"))
    moved = records.select("monitor", F.expr(_MOVED).alias("change"))
    return feeds.monitor_comparison(records.select("monitor").distinct(), members, moved, field_changes(spark, sf_dir), "monitor", "user_id")


@query(_PLACED + f"""SELECT (SELECT count(*) FROM r) AS current_entities, (SELECT count(*) FROM r WHERE c_acctbal > 9000) AS new_entities, count(*) AS change_events, count(DISTINCT user_id) AS changed_entities,
count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'important') AS important, count(*) FILTER (field_name = 'status_id') AS status_transitions, CAST(0 AS BIGINT) AS outcome_changes, CAST(0 AS BIGINT) AS outcome_changed_entities,
count(*) FILTER (field_name = 'enrollment') AS enrollment_changes, CAST(0 AS BIGINT) AS timeline_changes, CAST(0 AS BIGINT) AS country_changes,
(SELECT count(*) FROM r WHERE {_MOVED} = 'entered') AS entered, (SELECT count(*) FROM r WHERE {_MOVED} = 'left') AS "left", (SELECT count(*) FROM r WHERE {_MOVED} = 'reentered') AS reentered FROM e""")
def overview_counts(spark, sf_dir):
    records = _records(spark, sf_dir)
    current = records.select("user_id", (F.col("c_acctbal") > 9000).alias("is_new"))
    return feeds.overview_counts(_events(spark, sf_dir), records.select(F.expr(_MOVED).alias("change")), current, "user_id")


def _overview(spark, sf_dir):
    records = _records(spark, sf_dir)
    current = records.select("user_id", (F.col("c_acctbal") > 9000).alias("is_new"), F.col("monitor").alias("phase"), F.struct("registry").alias("rank"))
    return feeds.overview(_events(spark, sf_dir), records.select(F.expr(_MOVED).alias("change")), current, "user_id", "ts", "registry", F.col("field_name"))


@query(_PLACED + """, n AS (SELECT *, row_number() OVER (PARTITION BY old_value, new_value ORDER BY ts DESC, event_id) AS nth FROM e WHERE field_name = 'status_id')
SELECT old_value, new_value, count(*) AS n, array_to_string(list(event_id ORDER BY ts DESC, event_id) FILTER (nth <= 20), ',') AS items FROM n GROUP BY ALL""")
def overview_transitions(spark, sf_dir):
    found = _overview(spark, sf_dir)["transitions"]
    return found.select("old_value", "new_value", "n", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("""SELECT l_returnflag || l_linestatus AS phase, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_shipmode_rank WHEN 1 THEN 0 ELSE 1 END, l_linenumber, l_partkey, l_suppkey) AS nth FROM (SELECT *, CASE WHEN l_quantity > 25 THEN 1 ELSE 2 END AS l_shipmode_rank FROM lineitem)) WHERE nth = 1 GROUP BY 1""")
def phase_distribution(spark, sf_dir):
    """Phases of current entities, each counted by its canonical record."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("phase"), F.when(F.col("l_quantity") > 25, 0).otherwise(1).alias("source"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("tie"))
    first = intel.canonical_record(rows, "l_orderkey", F.col("source"), "tie")
    return first.groupBy("phase").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT event_id AS note_id, user_id AS event_id, user_id % 6 AS monitor_id, user_id AS entity, CASE WHEN event_type = 'click' THEN 'email' ELSE 'in_app' END AS channel, event_type AS status, 'kept ' || event_type AS name_kept FROM events),
s AS (SELECT event_id, arg_min(status, note_id) AS sibling_status FROM n WHERE channel = 'email' GROUP BY 1)
SELECT note_id, n.event_id, entity, coalesce(r_name, name_kept) AS monitor_name, n_name AS source, sibling_status FROM n LEFT JOIN region ON r_regionkey = monitor_id LEFT JOIN customer ON c_custkey = entity LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN s ON s.event_id = n.event_id WHERE channel = 'in_app'""")
def notification_feed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    notes = e.select(F.col("event_id").alias("note_id"), F.col("user_id").alias("event_id"), (F.col("user_id") % 6).alias("monitor_id"), F.col("user_id").alias("entity"), F.when(F.col("event_type") == "click", "email").otherwise("in_app").alias("channel"), F.col("event_type").alias("status"), F.concat(F.lit("kept "), "event_type").alias("name_kept"))
    monitors = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("monitor_id"), F.col("r_name").alias("name"))
    canonical = _records(spark, sf_dir).select(F.col("user_id").alias("entity"), F.col("registry").alias("source"))
    return feeds.notification_feed(notes, monitors, canonical)


@query("SELECT event_id, value / 100.0 AS confidence FROM events WHERE event_type = 'view' AND value / 100.0 >= 0.5 AND value / 100.0 <= 0.9 ORDER BY confidence DESC, event_id LIMIT 100")
def review_batch(spark, sf_dir):
    queue = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100.0).alias("confidence"), F.when(F.col("event_type") == "view", "pending").otherwise("done").alias("status"))
    return feeds.queue_batch(queue, "event_id", 0.5, 0.9, 100).select("event_id", "confidence")


@query("SELECT p_partkey, p_size FROM part ORDER BY p_brand = 'Brand#11' DESC, lower(p_name), p_partkey LIMIT 50")
def saved_search_order(spark, sf_dir):
    searches = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_brand") == "Brand#11").alias("pinned"), "p_size")
    return searches.orderBy(*feeds.saved_order(searches, "name")).limit(50).select(F.col("id").alias("p_partkey"), "p_size")


@query("SELECT event_type, count(*) FILTER (value >= 50) AS n_latest, date_trunc('second', max(ts)) AS last_crawl, epoch(TIMESTAMP '2024-02-13 23:59:00') - epoch(date_trunc('second', max(ts))) > 14 * 86400 AS is_stale FROM events GROUP BY 1")
def sync_state(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return feeds.sync_state(rows, "event_type", "ts", F.col("value") >= 50, "2024-02-13 23:59:00")


@query("SELECT lang, count(*) AS n_hits FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token') OR contains(lower(source), 'license') OR contains(lower(source), 'token') GROUP BY 1")
def case_hits(spark, sf_dir):
    return feeds.case_hits(table(spark, sf_dir, "documents"), "lang", ["text", "source"], ["License", "token"])


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS v, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM events)
WHERE v = 1 AND c <= 20 AND ts > TIMESTAMP '2024-01-02 00:00:00' AND event_type <> 'error' ORDER BY ts DESC, event_id LIMIT 200""")
def digest_news(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type")
    rows = table(spark, sf_dir, "events").withColumns({"v": F.row_number().over(w.orderBy("ts", "event_id")), "c": F.count("*").over(w)})
    return feeds.digest_news(rows, "ts", "2024-01-02 00:00:00", "2024-01-31 00:00:00", F.col("event_type") == "error", F.col("v"), F.col("c") <= 20, [F.desc("ts"), F.asc("event_id")]).select("event_id", "user_id")


@query("""WITH m AS (SELECT p_partkey AS record, min(p_partkey) OVER (PARTITION BY p_name) AS master, p_type, p_brand || '-' || p_size AS code FROM part),
i AS (SELECT record, 'CTR' AS type, code AS value, 0.7 AS confidence, 1 AS nth FROM m UNION ALL SELECT record, 'ProtocolNumber', p_type || code, 0.6, 2 FROM m),
h AS (SELECT type, value, master, count(DISTINCT record) AS n, min(record) AS only_one FROM i JOIN m USING (record) GROUP BY ALL),
a AS (SELECT i.*, h.master FROM i JOIN h USING (type, value) WHERE n > 1 OR only_one <> record),
f AS (SELECT *, row_number() OVER (PARTITION BY record, master ORDER BY nth, type, value) AS k, CASE WHEN type = 'CTR' OR confidence >= 0.9 THEN 'AUTO_CONFIRMED' ELSE 'POSSIBLE' END AS status FROM a)
SELECT record, master, 'identifier_match ' || type AS method, CAST(confidence AS DOUBLE) AS confidence, status, CAST(row_number() OVER (PARTITION BY record ORDER BY status, confidence DESC, master) AS INTEGER) AS rank FROM f WHERE k = 1""")
def master_matches(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("code", F.concat_ws("-", "p_brand", F.col("p_size").cast("string")))
    names = part.groupBy("p_name").agg(F.min("p_partkey").alias("master"))
    masters = part.join(names, "p_name").select(F.col("p_partkey").alias("record"), "master")
    ids = part.select(F.col("p_partkey").alias("record"), F.explode(F.array(F.struct(F.lit("CTR").alias("type"), F.col("code").alias("value"), F.lit(0.7).alias("confidence"), F.lit(1).alias("nth")), F.struct(F.lit("ProtocolNumber").alias("type"), F.concat("p_type", "code").alias("value"), F.lit(0.6).alias("confidence"), F.lit(2).alias("nth")))).alias("x")).select("record", "x.*")
    return resolve.master_matches(ids, masters, "record")
