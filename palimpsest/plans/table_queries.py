"""Queries over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intel, monitors, quality, rules, scopes, versions
from .base import query, table

_PART = {"query": ["p_name", "p_type"], "registries": "p_brand", "statuses": "p_brand", "study_types": "p_type", "phase": "p_type", "country": "p_brand", "sponsor": "p_brand", "condition": "p_name", "intervention": "p_type"}


@query("SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE contains(lower(coalesce(p_name,'') || ' ' || coalesce(p_type,'')), 'small') AND (contains(lower(p_brand), '1') OR contains(lower(p_brand), '3')) ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 5")
def rule_search_parts(spark, sf_dir):
    found = rules.search(table(spark, sf_dir, "part"), {"query": "SMALL", "sponsor": ["1", "3"]}, _PART)
    return rules.page(found, [F.desc("p_size"), F.asc("p_partkey")], 5, 25).select("p_partkey", "p_name", "p_brand", "p_size")


@query("""SELECT facet, value, count(*) AS n FROM (SELECT 'brand' AS facet, p_brand AS value FROM part UNION ALL SELECT 'size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT 'word', unnest(string_split(p_name, ' ')) FROM part) WHERE trim(value) <> '' GROUP BY ALL""")
def search_facets(spark, sf_dir):
    return rules.facets(table(spark, sf_dir, "part"), {"brand": F.col("p_brand"), "size": F.col("p_size")}, {"word": F.split("p_name", " ")})


@query("SELECT p_type, CASE WHEN lower(p_type) LIKE '%promo%' THEN 'promo' WHEN lower(p_type) LIKE '%large%' THEN 'large' WHEN lower(p_type) LIKE '%small%' THEN 'small' ELSE 'other' END AS bucket, count(*) AS n FROM part GROUP BY ALL")
def phase_style_bucket(spark, sf_dir):
    from ..functions.text import ordered_map

    bucket = ordered_map(F.col("p_type"), {}, [("promo", "promo"), ("large", "large"), ("small", "small")], F.lit("other"))
    return table(spark, sf_dir, "part").groupBy("p_type", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, array_to_string(list_sort(list(l_partkey))[1:50], ',') AS ids FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"))


@query("""SELECT 'error' AS severity, 'lineitem_order' AS code, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL SELECT 'error', 'lineitem_part', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey)
UNION ALL SELECT 'error', 'lineitem_supplier', count(*) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey)
UNION ALL SELECT 'warning', 'customer_without_orders', count(*) FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
UNION ALL SELECT 'warning', 'negative_balance', count(*) FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'error', 'order_key_repeated', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)""")
def integrity_audit(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    repeated = t("orders").groupBy("o_orderkey").count()
    return quality.audit(
        [
            quality.orphans(t("lineitem"), t("orders"), {"l_orderkey": "o_orderkey"}, "lineitem_order"),
            quality.orphans(t("lineitem"), t("part"), {"l_partkey": "p_partkey"}, "lineitem_part"),
            quality.orphans(t("lineitem"), t("supplier"), {"l_suppkey": "s_suppkey"}, "lineitem_supplier"),
            quality.orphans(t("customer"), t("orders"), {"c_custkey": "o_custkey"}, "customer_without_orders", "warning"),
            quality.broken_rule(t("customer"), F.col("c_acctbal") < 0, "negative_balance", "warning"),
            quality.broken_rule(repeated, F.col("count") > 1, "order_key_repeated"),
        ]
    )


@query("SELECT count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F')")
def orphan_checks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return scopes.outside(table(spark, sf_dir, "lineitem"), o, "l_orderkey").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def scope_semijoin_union(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    asia = c.join(n, c.c_nationkey == n.n_nationkey).join(r.filter("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey).select("c_custkey")
    building = c.filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return scopes.in_scope(table(spark, sf_dir, "orders"), "o_custkey", [asia, building]).select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)""")
def scope_two_keys(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select("c_custkey")
    large = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select("l_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("row_key", F.col("o_orderkey"))
    return scopes.in_either_scope(o, {"o_custkey": [rich], "o_orderkey": [large]}, "row_key").select("o_orderkey")


@query("""SELECT o_orderkey, o_orderpriority, EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R') AS returned FROM orders o""")
def existence_flag(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return scopes.flagged(table(spark, sf_dir, "orders"), keys, "o_orderkey", "returned").select("o_orderkey", "o_orderpriority", "returned")


_LINE = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"


def _lines(spark, sf_dir):
    li, s, n = (table(spark, sf_dir, x) for x in ("lineitem", "supplier", "nation"))
    return li.join(s.join(n, s.s_nationkey == n.n_nationkey), li.l_suppkey == s.s_suppkey)


@query(f"""SELECT l_orderkey, l_suppkey, n_name FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE n_name WHEN 'CHINA' THEN 0 WHEN 'GERMANY' THEN 1 WHEN 'FRANCE' THEN 2 ELSE 3 END, l_suppkey, l_linenumber, l_partkey) AS n FROM {_LINE}) WHERE n = 1""")
def canonical_record_per_id(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("tie", F.struct("l_suppkey", "l_linenumber", "l_partkey"))
    return intel.canonical_record(rows, "l_orderkey", intel.source_priority(F.col("n_name"), ["CHINA", "GERMANY", "FRANCE"]), "tie").select("l_orderkey", "l_suppkey", "n_name")


_FIELDS = """(SELECT l_orderkey, n_name, 'returnflag' AS field_name, l_returnflag AS value FROM {0} UNION ALL SELECT l_orderkey, n_name, 'linestatus', l_linestatus FROM {0})""".format(_LINE)


@query(f"SELECT l_orderkey, field_name, count(DISTINCT n_name) AS n_sources, count(DISTINCT value) AS n_values FROM {_FIELDS} GROUP BY ALL HAVING count(DISTINCT n_name) >= 2 AND count(DISTINCT value) > 1")
def cross_source_disagreement(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_orderkey", "n_name", F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))
    return intel.disagreements(rows, "l_orderkey", "n_name", ["returnflag", "linestatus"])


@query(f"""WITH d AS (SELECT * FROM {_FIELDS} WHERE value IS NOT NULL AND n_name IS NOT NULL), c AS (SELECT l_orderkey, field_name FROM d GROUP BY ALL HAVING count(DISTINCT value) > 1 AND count(DISTINCT n_name) > 1)
SELECT l_orderkey, field_name, value, count(DISTINCT n_name) AS n_sources, min(n_name) AS first_source FROM d JOIN c USING (l_orderkey, field_name) GROUP BY ALL""")
def conflict_values(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_orderkey", "n_name", F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))
    return intel.conflict_values(rows, "l_orderkey", "n_name", ["returnflag", "linestatus"])


@query(f"""WITH d AS (SELECT DISTINCT * FROM {_FIELDS}) SELECT a.field_name, a.n_name AS source_a, b.n_name AS source_b, count(DISTINCT a.l_orderkey) AS masters, count(*) AS pairs
FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.field_name = b.field_name AND a.n_name < b.n_name AND a.value <> b.value GROUP BY ALL""")
def conflict_counts(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("l_orderkey", "n_name", F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"))
    return intel.conflict_counts(rows, "l_orderkey", "n_name", ["returnflag", "linestatus"])


@query(f"SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(n_name)))[1:50], ',') AS sources, count(DISTINCT n_name) AS n_sources, count(DISTINCT l_linenumber) AS n_records FROM {_LINE} GROUP BY 1 HAVING count(DISTINCT n_name) > 1")
def mirror_groups(spark, sf_dir):
    return intel.mirror_groups(_lines(spark, sf_dir), "l_orderkey", "n_name", "l_linenumber")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_partners, array_to_string(list_sort(list_distinct(list(l_suppkey)))[1:50], ',') AS partners FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def identifier_many_masters(spark, sf_dir):
    return quality.several_partners(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey")


_BEFORE, _AFTER = "o_orderdate < TIMESTAMP '1995-06-01'", "o_orderdate >= TIMESTAMP '2001-03-01'"


@query(f"""WITH p AS (SELECT DISTINCT o_custkey FROM orders WHERE {_BEFORE}), c AS (SELECT DISTINCT o_custkey FROM orders WHERE {_AFTER})
SELECT coalesce(p.o_custkey, c.o_custkey) AS o_custkey, CASE WHEN p.o_custkey IS NOT NULL AND c.o_custkey IS NOT NULL THEN 'stayed' WHEN p.o_custkey IS NOT NULL THEN 'left' ELSE 'entered' END AS change FROM p FULL JOIN c ON p.o_custkey = c.o_custkey""")
def membership_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return monitors.membership_diff(o.filter("o_orderdate < timestamp_ntz'1995-06-01'"), o.filter("o_orderdate >= timestamp_ntz'2001-03-01'"), "o_custkey")


@query(f"""WITH p AS (SELECT DISTINCT o_custkey FROM orders WHERE {_BEFORE} AND o_orderstatus = 'F'), c AS (SELECT DISTINCT o_custkey FROM orders WHERE {_AFTER}), e AS (SELECT DISTINCT o_custkey FROM orders WHERE {_BEFORE})
SELECT c.o_custkey, CASE WHEN c.o_custkey IN (SELECT o_custkey FROM e) THEN 'reentered' ELSE 'entered' END AS change FROM c WHERE o_custkey NOT IN (SELECT o_custkey FROM p)
UNION ALL SELECT o_custkey, 'left' FROM p WHERE o_custkey NOT IN (SELECT o_custkey FROM c)
UNION ALL SELECT o_custkey, 'trial_changed' FROM c WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-07-01')""")
def monitor_run(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    before = o.filter("o_orderdate < timestamp_ntz'1995-06-01'")
    current = o.filter("o_orderdate >= timestamp_ntz'2001-03-01'").select("o_custkey").distinct()
    return monitors.run_monitor(before.filter("o_orderstatus = 'F'"), current, "o_custkey", o, "o_orderdate", "2001-07-01 00:00:00", ever=before)


@query(f"""WITH b AS (SELECT o_custkey, substr(sha256(concat_ws('||', CAST(count(*) AS VARCHAR), CAST(max(o_orderkey) AS VARCHAR))), 1, 32) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1),
c AS (SELECT o_custkey, substr(sha256(concat_ws('||', CAST(count(*) AS VARCHAR), CAST(max(o_orderkey) AS VARCHAR))), 1, 32) AS s FROM orders GROUP BY 1)
SELECT c.o_custkey, CASE WHEN b.s IS NULL THEN 'new' WHEN b.s <> c.s THEN 'changed' ELSE 'unchanged' END AS change FROM c LEFT JOIN b ON b.o_custkey = c.o_custkey""")
def baseline_new_changed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    state = lambda df: df.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("top")).withColumn("sign", monitors.signature(["n", "top"]))
    return monitors.baseline_diff(state(o.filter("o_orderdate < timestamp_ntz'1999-01-01'")), state(o), "o_custkey", "sign")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P, count(*) FILTER (o_orderstatus = 'F') / count(*) AS conversion FROM orders GROUP BY 1")
def funnel_conversion(spark, sf_dir):
    return quality.funnel(table(spark, sf_dir, "orders"), [F.col("o_orderpriority")], "o_orderstatus", "F", ["F", "O", "P"])


@query("SELECT l_orderkey, count(*) AS n_records, count(DISTINCT l_returnflag) AS n_l_returnflag, count(DISTINCT l_linestatus) AS n_l_linestatus, CAST(1 AS BIGINT) AS n_prefixes FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND (count(DISTINCT l_returnflag) > 1 OR count(DISTINCT l_linestatus) > 1)")
def false_merge_check(spark, sf_dir):
    return quality.false_merges(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"], "l_orderkey")


@query("""SELECT o_custkey, count(*) AS n_records, count(DISTINCT o_orderstatus) AS n_o_orderstatus, count(DISTINCT lower(substr(o_orderpriority, 3, 1))) AS n_prefixes FROM orders
GROUP BY 1 HAVING count(*) > 1 AND (count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT lower(substr(o_orderpriority, 3, 1))) > 1)""")
def false_merge_prefixes(spark, sf_dir):
    """Customers whose orders differ in status or in the letters that their id begins with."""
    o = table(spark, sf_dir, "orders").withColumn("id", F.concat(F.lower(F.substring("o_orderpriority", 3, 1)), F.col("o_orderkey").cast("string")))
    return quality.false_merges(o, "o_custkey", ["o_orderstatus"], "id")


@query("SELECT o_custkey, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n_records FROM orders GROUP BY 1 HAVING count(*) > 1 AND min(o_totalprice) > 0 AND max(o_totalprice) >= 1.5 * min(o_totalprice)")
def enrollment_ratio_outliers(spark, sf_dir):
    return quality.ratio_outliers(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 1.5)


@query("SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS day, count(DISTINCT o_custkey) AS customers, count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END) AS urgent FROM orders GROUP BY ALL")
def source_activity(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return intel.conditional_distinct(o, [F.col("o_orderstatus"), F.to_date("o_orderdate").alias("day")], F.col("o_custkey"), {"customers": F.lit(True), "urgent": F.col("o_orderpriority") == "1-URGENT"})


@query("""SELECT 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem""")
def table_inventory(spark, sf_dir):
    return quality.audit([table(spark, sf_dir, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("region", "nation", "customer", "orders", "lineitem")])


@query("""SELECT o_orderkey, o_orderdate, n_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""")
def unacknowledged_feed(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    rows = o.filter("o_orderstatus = 'P'").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey, "left")
    return rules.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], 0, 50).select("o_orderkey", "o_orderdate", "n_name", "c_mktsegment")


@query("""SELECT c_custkey, max(o_orderdate) AS last_order, count(*) FILTER (o_orderstatus = 'O') AS open_orders, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def per_row_aggregates(spark, sf_dir):
    agg = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_order"), F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.count("*").alias("n_orders"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(agg, "c_custkey", "left").select("c_custkey", "last_order", F.coalesce("open_orders", F.lit(0)).alias("open_orders"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n <= 3")
def top_k_per_group(spark, sf_dir):
    return versions.top_k(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey"], 3).select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey")


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def rollup_counts(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).rollup("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"))


@query("""SELECT id FROM (SELECT unnest(generate_series(1, (SELECT max(c_custkey) FROM customer))) AS id) WHERE id NOT IN (SELECT o_custkey FROM orders)""")
def id_range_candidates(spark, sf_dir):
    """Ids of the customers' range that no order names."""
    last = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] or 0
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return scopes.outside(spark.range(1, last + 1), known, "id")


@query("""SELECT id FROM (SELECT unnest(generate_series(1, (SELECT max(o_orderkey) FROM orders))) AS id) WHERE id NOT IN (SELECT o_orderkey FROM orders)""")
def id_gaps(spark, sf_dir):
    """Free ids up to the largest that is taken."""
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    last = known.agg(F.max("id")).first()[0] or 0
    return scopes.outside(spark.range(1, last + 1), known, "id")
