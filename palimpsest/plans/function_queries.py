"""Queries of the text functions and small write operators, on texts built from the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import records, resolve, rules, scopes, writes
from .base import query, table
from .event_queries import _PAIRS, field_changes

_PHASES = ("Phase I", "phase 2/3", "N/A", "pilot", "Ⅲ期")
_STATUS = ("Recruiting", "Not yet recruiting", "Completed", "Terminated", "招募完成")


def _pick(values, by):
    """The value of a list by a number, from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by + 1).cast("int"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT k, p || ';' || s || ' x' AS terms,
CASE WHEN s = 'F' THEN 'Final' WHEN d + 90 < DATE '1998-01-01' THEN 'Completed' WHEN d > DATE '1998-01-01' THEN 'Not yet recruiting' ELSE 'Recruiting' END AS dated,
CASE WHEN k % 2 = 0 THEN 'ord' || k ELSE 'ORD' || k END AS prefixed,
'Phase ' || (k % 3 + 1) || '/Phase ' || (k % 3 + 2) AS label,
CASE k % 5 WHEN 0 THEN 'Phase 1' WHEN 1 THEN 'Phase 2/3' WHEN 2 THEN 'N/A' WHEN 3 THEN 'Other' ELSE 'Phase 3' END AS bucket,
d AS written_date, CAST(k % 100 + k % 7 AS BIGINT) AS labelled, CAST(k % 50 + k % 9 AS BIGINT) AS grouped, CAST(1000 + k % 1000 AS BIGINT) AS first_number, CAST(1000 + k % 1000 AS BIGINT) AS digits,
p || ', ' || s AS shown, p AS inclusion, s AS exclusion, 'adult ' || p || ';no ' || s AS criteria, 'alive' AS primary_outcome, p AS secondary_outcome,
CASE k % 5 WHEN 0 THEN 'recruiting' WHEN 2 THEN 'completed' WHEN 3 THEN 'terminated' ELSE 'other' END AS status, 'ABC' AS prefix, k % 5 = 4 AS cjk FROM o""")
def record_texts(spark, sf_dir):
    """Every function of lists, dates, numbers, phases, statuses and criteria, on a text per order."""
    k, p, s, d = (F.col(c) for c in "kpsd")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.to_date("o_orderdate").alias("d"))
    n = lambda m: (k % m).cast("string")
    number = F.concat(F.lit("about 1,"), F.lpad(n(1000), 3, "0"))
    split = tx.eligibility_parts(F.concat(F.lit("Inclusion Criteria: "), p, F.lit("\nExclusion Criteria: "), s))
    parts = tx.outcome_parts(F.concat(F.lit("Primary: alive\nSecondary: "), p))
    written = F.when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(d, "dd/MM/yyyy")).otherwise(F.concat(F.date_format(d, "yyyy"), F.lit("年"), F.date_format(d, "MM"), F.lit("月"), F.date_format(d, "dd"), F.lit("日")))
    status = _pick(_STATUS, k % 5)
    return o.select(
        "k",
        F.array_join(tx.or_terms(F.concat(p, F.lit(' OR "'), s, F.lit(' x" OR '))), ";").alias("terms"),
        tx.dated_status(F.when(s == "F", "Final"), d, F.date_add(d, 90), "1998-01-01").alias("dated"),
        tx.prefixed_id(F.lit("ORD"), F.when(k % 2 == 0, F.concat(F.lit("ord"), k)).otherwise(k.cast("string"))).alias("prefixed"),
        tx.phase_label(F.concat(F.lit("PHASE"), (k % 3 + 1).cast("string"), F.lit("|PHASE"), (k % 3 + 2).cast("string"))).alias("label"),
        tx.phase_bucket(_pick(_PHASES, k % 5)).alias("bucket"),
        tx.iso_date(written).alias("written_date"),
        tx.labelled_sum(F.concat(F.lit("样本量:"), n(100), F.lit(";样本量："), n(7))).alias("labelled"),
        tx.group_sum(F.concat(F.lit("a:"), n(50), F.lit(";b: "), n(9))).alias("grouped"),
        tx.first_integer(number).alias("first_number"),
        tx.all_digits(number).alias("digits"),
        tx.display_list(F.concat(F.lit('["'), p, F.lit('","'), s, F.lit('"]'))).alias("shown"),
        split["inclusion"].alias("inclusion"),
        split["exclusion"].alias("exclusion"),
        F.array_join(tx.criteria_items(F.concat(F.lit("1. adult "), p, F.lit("\n2. no "), s)), ";").alias("criteria"),
        parts["primary"][0].alias("primary_outcome"),
        parts["secondary"][0].alias("secondary_outcome"),
        tx.status_bucket(status).alias("status"),
        tx.title_prefix(F.concat(F.lit("ABC12-"), n(1000))).alias("prefix"),
        tx.has_cjk(status).alias("cjk"),
    )


@query("""SELECT o_orderkey FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'Phase I' WHEN 1 THEN 'phase 2/3' WHEN 2 THEN 'N/A' WHEN 3 THEN 'pilot' ELSE 'Ⅲ期' END AS phase FROM orders)
WHERE lower(o_orderpriority) IN ('1-urgent', '5-low') AND lower(o_orderstatus) IN ('f', 'p') AND (phase = 'phase 2/3' OR phase = 'pilot')""")
def rule_fields(spark, sf_dir):
    """Sets of registries and statuses, and phases by text, bucket and the word other."""
    columns = dict.fromkeys(rules.RULE_FIELDS, "o_orderpriority") | {"statuses": "o_orderstatus", "phase": "phase", "query": ["o_orderpriority"]}
    o = table(spark, sf_dir, "orders").withColumn("phase", _pick(_PHASES, F.col("o_orderkey") % 5))
    return rules.search(o, {"registries": ["1-URGENT", "5-low"], "statuses": ["F", "p"], "phase": ["Phase 2/3", "other"]}, columns).select("o_orderkey")


@query("""SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""")
def pending_inserts(spark, sf_dir):
    """One order per customer that has nothing pending."""
    o = table(spark, sf_dir, "orders").withColumn("state", F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done"))
    return writes.insert_if_no_pending(o, o.filter("state = 'done'"), ["o_custkey"], order=["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN c_mktsegment = 'BUILDING' AND o_orderstatus = 'P' THEN 'approved' WHEN c_mktsegment = 'MACHINERY' THEN 'rejected' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'approved' END AS state
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def review_decisions(spark, sf_dir):
    """Approval of pending items only, rejection of any."""
    queue = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "P", "pending").otherwise("approved").alias("state"))
    said = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "approve").when(F.col("c_mktsegment") == "MACHINERY", "reject").alias("decision"))
    return resolve.decide(queue, said, ["o_custkey"]).select("o_orderkey", "state")


@query(_PAIRS + """SELECT event_id, CASE old_value WHEN 'click' THEN 'Click' WHEN 'error' THEN 'Fault' ELSE old_value END AS old_value, CASE new_value WHEN 'click' THEN 'Click' WHEN 'error' THEN 'Fault' ELSE new_value END AS new_value FROM k WHERE field_name = 'status_id'""")
def labelled_changes(spark, sf_dir):
    found = field_changes(spark, sf_dir, ("status_id",))
    return records.labelled_values(found, {"click": "Click", "error": "Fault"}).select("event_id", "old_value", "new_value")


@query("""SELECT event_id FROM (SELECT *, row_number() OVER w AS n, lead(event_id) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id)) WHERE n = 1 AND later IS NULL AND value < 50""")
def first_of_chain(spark, sf_dir):
    from ..operators import versions

    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    chain = versions.version_chain(events, ["user_id", "event_type", "day"], ["ts", "event_id"], "event_id")
    return chain.filter(records.first_of_chain(F.col("version_number"), F.col("is_latest"), F.col("value") >= 50)).select("event_id")


@query("""WITH p AS (SELECT user_id, ts, value AS paid FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'purchase') WHERE n = 1)
SELECT event_id, e.user_id, paid FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def last_value_as_of(spark, sf_dir):
    """Each fault with the last purchase before it."""
    e = table(spark, sf_dir, "events")
    faults = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    paid = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("paid"), F.col("event_id").alias("tie"))
    return scopes.as_of(faults, paid, ["user_id"], "ts", "paid", "tie").select("event_id", "user_id", "paid")
