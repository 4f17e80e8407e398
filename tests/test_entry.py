"""The driver's contract, and each query against its SQL on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["change_severity_by_day", "version_chain", "event_hash_first_seen", "search_facets", "scope_two_keys", "membership_diff", "monitor_run", "keyword_word_boundary", "ngram_mining", "trigram_candidates", "entity_components", "update_feed_report", "overview_counts", "version_list", "master_matches", "record_texts", "last_value_as_of", "conflict_counts", "project_cards", "conflict_values", "duplicate_keys", "identifier_many_masters", "mirror_groups", "watch_preferences"]
NAMES += ["distinct_users_by_window", "value_quantiles_by_type", "count_min_users", "resolution_in_order", "late_version_delta", "orders_open_together", "customers_in_supplier_range", "membership_in_order"]
NAMES += ["protocol_clashes", "cross_language_pairs", "balance_discrepancies"]


def test_keys_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    from palimpsest.plans import registry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    plain = lambda v: float(f"{v:.12g}") if isinstance(v, float) else v
    mine = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    result = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert mine == sorted(str([plain(r[i]) for i in at]) for r in result.fetchall())
