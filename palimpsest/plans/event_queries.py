"""Queries over the version chains of ``events``: key user_id, order (ts, event_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, intel, monitors, quality, scopes, versions, writes
from ..operators.severity import classify_change, severity_rank
from ..streaming import streams
from .base import query, table

KEY, ORDER = ["user_id"], ["ts", "event_id"]
AS_OF = "2024-01-31 00:00:00"

_PAIRS = """
WITH v AS (
  SELECT *, lag(event_type) OVER w AS old_type, lag(value) OVER w AS old_num, lag(event_id) OVER w AS old_id
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), c AS (
  SELECT event_id, user_id, ts, 'status_id' AS field_name, old_type AS old_value, event_type AS new_value FROM v WHERE old_id IS NOT NULL AND old_type <> event_type
  UNION ALL
  SELECT event_id, user_id, ts, 'enrollment', CAST(old_num AS VARCHAR), CAST(value AS VARCHAR) FROM v WHERE old_id IS NOT NULL AND CAST(old_num AS VARCHAR) <> CAST(value AS VARCHAR)
), s AS (
  SELECT *, TRY_CAST(old_value AS DOUBLE) AS a, TRY_CAST(new_value AS DOUBLE) AS b FROM c
), k AS (
  SELECT event_id, user_id, ts, field_name, old_value, new_value,
    CASE WHEN field_name = 'status_id' THEN CASE WHEN new_value = 'error' THEN 'critical' ELSE 'important' END
         WHEN a = 0 THEN 'important' WHEN abs(b - a) / abs(a) >= 0.2 THEN 'important' ELSE 'normal' END AS severity,
    CASE WHEN field_name = 'status_id' THEN 'status_transition' WHEN a = 0 THEN 'modified' WHEN b > a THEN 'numeric_increase' ELSE 'numeric_decrease' END AS change_type,
    CASE WHEN field_name = 'status_id' THEN CASE WHEN new_value = 'error' THEN 95.0 ELSE 60.0 END
         WHEN a = 0 THEN 60.0 WHEN abs(b - a) / abs(a) >= 0.2 THEN 63.0 ELSE 30.0 END AS importance_score
  FROM s
)
"""


def field_changes(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("status_id", "enrollment")) -> DataFrame:
    """Changes of type and value with severity."""
    chain = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("status_id"), F.col("value").alias("enrollment"))
    found = changes.detect_changes(chain, KEY, ORDER, list(fields), carry=["event_id", "ts"])
    graded = classify_change(F.col("field_name"), F.col("old_value"), F.col("new_value"), terminal="^error$")
    return found.withColumn("g", graded).select("event_id", "user_id", "ts", "field_name", "old_value", "new_value", "g.*")


@query(_PAIRS + "SELECT CAST(ts AS DATE) AS day, severity, count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM k GROUP BY ALL")
def change_severity_by_day(spark, sf_dir):
    # a user's changes of a day and severity combine before users are counted
    each = field_changes(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "severity", "user_id").agg(F.count("*").alias("n"))
    return each.groupBy("day", "severity").agg(F.sum("n").alias("n_events"), F.count("*").alias("n_users"))


@query(_PAIRS + "SELECT event_id, field_name, old_value, new_value, severity, change_type, CAST(importance_score AS DOUBLE) AS importance_score FROM k")
def change_events(spark, sf_dir):
    return field_changes(spark, sf_dir).select("event_id", "field_name", "old_value", "new_value", "severity", "change_type", "importance_score")


@query("""SELECT event_id, user_id, CAST(row_number() OVER w AS BIGINT) AS version_number, lead(event_id) OVER w AS superseded_by, lead(event_id) OVER w IS NULL AS is_latest
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def version_chain(spark, sf_dir):
    return versions.version_chain(table(spark, sf_dir, "events"), KEY, ORDER, "event_id").select("event_id", "user_id", F.col("version_number").cast("long").alias("version_number"), "superseded_by", "is_latest")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR b <> event_type""")
def unchanged_version_skip(spark, sf_dir):
    return versions.skip_unchanged(table(spark, sf_dir, "events"), KEY, ORDER, ["event_type"]).select("event_id", "user_id", "event_type")


@query(_PAIRS + """, h AS (SELECT *, sha256(concat_ws('|', CAST(user_id AS VARCHAR), field_name, new_value)) AS event_hash FROM k WHERE field_name = 'status_id'),
r AS (SELECT *, row_number() OVER (PARTITION BY event_hash ORDER BY ts, event_id) AS n FROM h)
SELECT event_hash, event_id, user_id, old_value, new_value FROM r WHERE n = 1""")
def event_hash_first_seen(spark, sf_dir):
    found = field_changes(spark, sf_dir, ("status_id",))
    hashed = found.withColumn("event_hash", changes.event_hash(["user_id"], F.col("field_name"), F.col("new_value")))
    return changes.first_events(hashed, ["ts", "event_id"]).select("event_hash", "event_id", "user_id", "old_value", "new_value")


@query(_PAIRS + "SELECT old_value AS from_value, new_value AS to_value, count(*) AS n, count(DISTINCT user_id) AS entities FROM k WHERE field_name = 'status_id' GROUP BY ALL")
def status_transition_matrix(spark, sf_dir):
    return intel.transition_matrix(field_changes(spark, sf_dir, ("status_id",)), "old_value", "new_value", "user_id")


@query(_PAIRS + """SELECT event_id, user_id, old_value, new_value, TRY_CAST(new_value AS DOUBLE) - TRY_CAST(old_value AS DOUBLE) AS delta FROM k
WHERE field_name = 'enrollment' ORDER BY abs(TRY_CAST(new_value AS DOUBLE) - TRY_CAST(old_value AS DOUBLE)) DESC, event_id LIMIT 20""")
def numeric_delta_topk(spark, sf_dir):
    found = intel.numeric_deltas(field_changes(spark, sf_dir, ("enrollment",)), "old_value", "new_value")
    return found.orderBy(F.desc(F.abs("delta")), "event_id").limit(20).select("event_id", "user_id", "old_value", "new_value", "delta")


@query(_PAIRS + """SELECT user_id, count(*) AS n_events, CAST(max(CASE severity WHEN 'critical' THEN 4 WHEN 'important' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END) AS INTEGER) AS top_rank, max(ts) AS last_event
FROM k GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 10""")
def per_trial_activity_topk(spark, sf_dir):
    return intel.entity_activity(field_changes(spark, sf_dir), "user_id", "ts", severity_rank(F.col("severity")), 10)


@query("""SELECT d.day, coalesce(c.n, 0) AS n FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) c USING (day)""")
def dense_trend_calendar(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return intel.dense_calendar(daily, "day", "2023-12-25", "2024-02-05", ["n"])


_CATEGORY = {"click": "interest", "view": "interest", "purchase": "money", "error": "fault"}


@query("SELECT CASE event_type WHEN 'click' THEN 'interest' WHEN 'view' THEN 'interest' WHEN 'purchase' THEN 'money' WHEN 'error' THEN 'fault' ELSE 'other' END AS category, count(*) AS n FROM events GROUP BY 1")
def category_histogram(spark, sf_dir):
    return intel.histogram(table(spark, sf_dir, "events"), changes.field_category(F.col("event_type"), _CATEGORY), "category", "other")


@query(f"""SELECT event_type, last_seen, CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(last_seen) AS BIGINT) AS age_seconds,
CASE WHEN epoch(TIMESTAMP '{AS_OF}') - epoch(last_seen) <= 3600 * 7 THEN 'fresh' WHEN epoch(TIMESTAMP '{AS_OF}') - epoch(last_seen) <= 3600 * 3 THEN 'delayed' ELSE 'stale' END AS state
FROM (SELECT event_type, date_trunc('second', max(ts)) AS last_seen FROM events GROUP BY 1)""")
def freshness_by_source(spark, sf_dir):
    seen = table(spark, sf_dir, "events").groupBy("event_type").agg(F.date_trunc("second", F.max("ts")).cast("timestamp_ntz").alias("last_seen"))
    aged = intel.freshness(seen, "event_type", "last_seen", AS_OF, F.lit(1))
    return aged.select("event_type", "last_seen", F.round(F.col("age_hours") * 3600).cast("long").alias("age_seconds"), "state")


@query(f"""SELECT user_id, last_seen, CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(last_seen) AS BIGINT) AS age_seconds,
CASE WHEN epoch(TIMESTAMP '{AS_OF}') - epoch(last_seen) <= 3600 * 14 THEN 'fresh' WHEN epoch(TIMESTAMP '{AS_OF}') - epoch(last_seen) <= 3600 * 24 THEN 'delayed' ELSE 'stale' END AS state
FROM (SELECT user_id, date_trunc('second', max(ts)) AS last_seen FROM events GROUP BY 1)""")
def freshness_by_user(spark, sf_dir):
    """A cadence of 8 hours, at which all three states occur."""
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(F.date_trunc("second", F.max("ts")).cast("timestamp_ntz").alias("last_seen"))
    aged = intel.freshness(seen, "user_id", "last_seen", AS_OF, F.lit(8))
    return aged.select("user_id", "last_seen", F.round(F.col("age_hours") * 3600).cast("long").alias("age_seconds"), "state")


@query("SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'faults' WHEN value >= 50 THEN 'large' END AS profile FROM events WHERE event_id > 500 AND (event_type = 'error' OR value >= 50)")
def digest_after_watermark(spark, sf_dir):
    found = monitors.digest(table(spark, sf_dir, "events"), "event_id", 500, [("faults", F.col("event_type") == "error"), ("large", F.col("value") >= 50)])
    return found.select("event_id", "user_id", "profile")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def payload_path_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"SELECT count(*) AS events, count(DISTINCT user_id) AS entities FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:01'")
def window_totals(spark, sf_dir):
    first, last = scopes.window_bounds("7d", AS_OF)
    return intel.totals(table(spark, sf_dir, "events").filter(scopes.time_window(F.col("ts"), first, last)), "user_id")


@query("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00'")
def open_window_feed(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(scopes.time_window(F.col("ts"), "2024-01-30 00:00:00", "", half_open=False)).select("event_id", "user_id")


@query(_PAIRS + "SELECT CAST(ts AS DATE) AS day, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'important') AS important, count(*) FILTER (severity = 'normal') AS normal FROM k GROUP BY 1")
def severity_trend_pivot(spark, sf_dir):
    return intel.daily_trend(field_changes(spark, sf_dir), "ts", "severity", ["critical", "important", "normal"])


@query(_PAIRS + "SELECT severity, count(*) AS n FROM k GROUP BY 1")
def severity_histogram(spark, sf_dir):
    return intel.histogram(field_changes(spark, sf_dir), F.col("severity"), "severity", "normal")


@query(_PAIRS + ", r AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY ts DESC, event_id, field_name) AS rank FROM k) SELECT severity, event_id, field_name, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def severity_samples(spark, sf_dir):
    return versions.top_k(field_changes(spark, sf_dir), ["severity"], [F.desc("ts"), "event_id", "field_name"], 5).select("severity", "event_id", "field_name", "rank")


@query(_PAIRS + "SELECT user_id, event_id, count(*) AS n_changes, CAST(max(CASE severity WHEN 'critical' THEN 4 WHEN 'important' THEN 3 WHEN 'normal' THEN 2 ELSE 1 END) AS INTEGER) AS top_rank FROM k GROUP BY ALL")
def version_timeline(spark, sf_dir):
    return field_changes(spark, sf_dir).groupBy("user_id", "event_id").agg(F.count("*").alias("n_changes"), F.max(severity_rank(F.col("severity"))).alias("top_rank"))


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_changed FROM events GROUP BY 1")
def entity_lifetimes(spark, sf_dir):
    return versions.lifetimes(table(spark, sf_dir, "events"), KEY, "ts", "ts")


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_versions(spark, sf_dir):
    return versions.latest(table(spark, sf_dir, "events"), KEY, ORDER).select("event_id", "user_id", "event_type", "value")


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events)
SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak FROM e""")
def failure_streaks(spark, sf_dir):
    return versions.failure_streaks(table(spark, sf_dir, "events"), KEY, ORDER, F.col("event_type") == "error").select("event_id", "user_id", F.col("streak").cast("long").alias("streak"))


@query("""WITH v AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT a.user_id, a.event_type AS event_type_from, b.event_type AS event_type_to, a.value AS value_from, b.value AS value_to, b.value - a.value AS delta FROM v a JOIN v b USING (user_id) WHERE a.n = 1 AND b.n = 3""")
def version_compare(spark, sf_dir):
    chain = versions.version_chain(table(spark, sf_dir, "events"), KEY, ORDER, "event_id")
    return versions.version_pairs(chain, KEY, 1, 3, ["event_type", "value"]).withColumn("delta", F.col("value_to") - F.col("value_from"))


def _insert_ignore_sql(day: str) -> str:
    return f"""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE ts >= TIMESTAMP '{day}') e
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.ts < TIMESTAMP '{day}' AND o.user_id = e.user_id AND o.event_type = e.event_type)"""


_UPSERT_SQL = "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


def _sides(spark: SparkSession, sf_dir: str, day: str) -> tuple[DataFrame, DataFrame]:
    """All events, on one side or the other of a day."""
    e = table(spark, sf_dir, "events")
    return e.filter(f"ts < timestamp_ntz'{day}'"), e.filter(f"ts >= timestamp_ntz'{day}'")


@query(_insert_ignore_sql("2024-01-05"))
def insert_ignore(spark, sf_dir):
    return writes.insert_ignore(*_sides(spark, sf_dir, "2024-01-05"), ["user_id", "event_type"], ORDER).select("user_id", "event_type", "event_id")


@query(_UPSERT_SQL)
def upsert(spark, sf_dir):
    return writes.upsert(*_sides(spark, sf_dir, "2024-01-25"), KEY, ORDER).select("user_id", "event_id", "value")


@query(_insert_ignore_sql("2024-01-15"))
def insert_ignore_all(spark, sf_dir):
    return writes.insert_ignore(*_sides(spark, sf_dir, "2024-01-15"), ["user_id", "event_type"], ORDER).select("user_id", "event_type", "event_id")


@query(_UPSERT_SQL)
def upsert_all(spark, sf_dir):
    return writes.upsert(*_sides(spark, sf_dir, "2024-01-15"), KEY, ORDER).select("user_id", "event_id", "value")


@query("""SELECT event_id, CAST(n AS BIGINT) AS attempts, CASE WHEN event_type = 'error' AND n >= 3 THEN 'failed' ELSE 'pending' END AS state
FROM (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS n FROM events)""")
def attempt_counter(spark, sf_dir):
    q = table(spark, sf_dir, "events").select("event_id", "event_type", F.lit("pending").alias("state"), (F.get_json_object("props", "$.k").cast("long") % 4).alias("attempts"))
    return writes.count_attempt(q, F.col("event_type") == "error").select("event_id", "attempts", "state")


@query("""SELECT event_id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-30 22:00:00' THEN 'interrupted' WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS status FROM events""")
def stale_claims(spark, sf_dir):
    claims = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"))
    return monitors.stale_claims(claims, "ts", AS_OF, 120).select("event_id", "status")


@query("SELECT event_id, CAST(CASE WHEN 1706659200 < epoch(ts) THEN epoch(ts) ELSE epoch(ts) + (floor((1706659200 - epoch(ts)) / 86400) + 1) * 86400 END AS BIGINT) AS next_due FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def schedule_next_due(spark, sf_dir):
    anchor = F.unix_timestamp(F.date_trunc("second", F.col("ts")).cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", monitors.next_due_column(anchor, F.lit(86400), F.lit(1706659200)).cast("long").alias("next_due"))


@query("""WITH e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND value >= 90), c AS (SELECT * FROM (VALUES ('app'), ('mail')) t(channel))
SELECT event_id, channel FROM e CROSS JOIN c WHERE NOT (channel = 'app' AND event_type = 'click')""")
def outbox_reconcile(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value >= 90")
    sent = e.filter("event_type = 'click'").select("event_id", F.lit("app").alias("channel"))
    return monitors.reconcile_outbox(e.select("event_id", "ts"), ["app", "mail"], sent, ["event_id"], F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id", "channel")


@query("SELECT event_type, CAST(sum(length(props)) AS BIGINT) AS chars, count(*) AS n, CAST((SELECT sum(length(props)) FROM events) AS BIGINT) AS all_chars FROM events GROUP BY 1")
def payload_size(spark, sf_dir):
    return quality.payload_size(table(spark, sf_dir, "events"), ["event_type"], "props")


@query("SELECT CASE WHEN v < 0.7 THEN '<0.70' WHEN v < 0.8 THEN '0.70-0.80' WHEN v < 0.9 THEN '0.80-0.90' ELSE '>=0.90' END AS bucket, count(*) AS n FROM (SELECT value / 100.0 AS v FROM events) GROUP BY 1")
def confidence_histogram(spark, sf_dir):
    return quality.confidence_histogram(table(spark, sf_dir, "events"), F.col("value") / 100.0, [0.7, 0.8, 0.9])


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the time type that watermarks need."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    counts = streams.windowed_counts(_instants(spark, sf_dir), "ts", ["event_type"], "1 day")
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT make_timestamp(CAST((floor(epoch(ts) / 43200) - k) * 43200000000 AS BIGINT)) AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    """Windows of a day, a new one every twelve hours."""
    counts = streams.windowed_counts(_instants(spark, sf_dir), "ts", ["event_type"], "1 day", "12 hours")
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(spark, sf_dir):
    w = F.session_window(F.col("ts"), "6 hours")
    return table(spark, sf_dir, "events").groupBy("user_id", w).agg(F.min("ts").alias("first_ts"), F.count("*").alias("n")).select("user_id", "first_ts", "n")


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY CUBE (event_type, CAST(ts AS DATE))")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).cube("event_type", "day").agg(F.count("*").alias("n"))


@query(_PAIRS + """, p AS (SELECT c_custkey AS watch_id, 'status' AS g, c_mktsegment <> 'AUTOMOBILE' AS enabled, 'critical' AS least FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')
  UNION ALL SELECT c_custkey, 'enrollment', TRUE, 'important' FROM customer WHERE c_mktsegment <> 'FURNITURE'),
r AS (SELECT c_custkey AS watch_id, k.*, CASE field_name WHEN 'status_id' THEN 'status' ELSE 'enrollment' END AS g FROM k JOIN customer ON c_custkey = user_id)
SELECT r.watch_id, event_id, field_name, severity FROM r LEFT JOIN p USING (watch_id, g) WHERE coalesce(enabled, TRUE) AND (severity = 'critical' OR (severity = 'important' AND coalesce(least, 'normal') <> 'critical') OR (severity = 'normal' AND coalesce(least, 'normal') = 'normal'))""")
def watch_preferences(spark, sf_dir):
    """Changes that customers' preferences let through: status from critical on or off, numbers from important on."""
    customers = table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    prefer = lambda keep, group, on, least: customers.filter(keep).select(F.col("c_custkey").alias("watch_id"), F.lit(group).alias("field_group"), on.alias("enabled"), F.lit(least).alias("minimum_severity"))
    preferences = prefer(segment.isin("AUTOMOBILE", "BUILDING"), "status", segment != "AUTOMOBILE", "critical").unionByName(prefer(segment != "FURNITURE", "enrollment", F.lit(True), "important"))
    watches = customers.select(F.col("c_custkey").alias("watch_id"), F.col("c_custkey").alias("user_id"))
    found = monitors.preferred_events(field_changes(spark, sf_dir), watches, preferences, "user_id", changes.field_category(F.col("field_name")), F.col("severity"))
    return found.select("watch_id", "event_id", "field_name", "severity")
