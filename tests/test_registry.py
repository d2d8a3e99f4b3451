"""A slice of the registered queries against their SQL on the smallest tables; `python -m registry.check` runs all."""

import pytest

import __spark_entry__ as entry
from registry.check import compare, connect

NAMES = ["t1_normalize", "d1_exact_dedupe", "p6_terms", "r1_score", "g7_geoparse", "c3_labels", "a1_themes", "a9_funnel", "g15_stacks",
         "a18_exact_counts", "x3_csv_lines", "k6_store_evict", "st1_stream_triage", "st5_stream_dedupe", "s1_read_csv", "o7_full_triage"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    note, ok, _ = compare(spark, connect(sf), sf, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


def test_every_query_has_sql():
    from registry import all_queries, all_sql
    assert set(all_queries()) == set(all_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_stack_listing_limits_before_the_shuffle(spark, sf):
    plan = entry.queries()["g20_stack_listing"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_geoparse_needs_no_shuffle_and_no_python(spark, sf):
    from postsieve.operators import geo
    from registry import views
    df = geo.geoparse(views.table(spark, sf, "documents").selectExpr("doc_id AS seq", "text", "CAST(null AS DOUBLE) AS lat", "CAST(null AS DOUBLE) AS lon"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
