"""The physical plans are the ones intended."""

import re

import pytest
from pyspark.sql import functions as F

from lakestrata.operators import joins, windows
from lakestrata.plans import layered
from lakestrata.sources.write import write_layer
from lakestrata.workload import load_all
from tests.conftest import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [
    "product_sales_month", "spend_by_nation_premium", "daily_sales_summary", "first_last_status", "previous_event",
    "pivot_events", "column_profile", "dimension_enrichment", "orphan_foreign_keys", "row_overlap", "dwd_latest_lines",
    "layer_backfill", "scd2_history", "scd2_incremental", "compare_tables", "similar_schemas", "flow_compliance",
    "convention_violations", "convention_scores", "quality_report", "merge_customers", "upsert_customers",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_product(spark, name):
    text = plan(load_all()[name].build(spark, DATA))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(load_all()["monthly_revenue"].build(spark, DATA))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in text


def test_keep_latest_cuts_rows_before_the_shuffle(spark):
    df = spark.read.parquet(f"{DATA}/lineitem.parquet")
    text = plan(windows.keep_latest(df, ["l_orderkey", "l_linenumber"], "l_shipdate"))
    below_exchange = text.split("Exchange hashpartitioning", 1)[1]
    assert "WindowGroupLimit" in below_exchange


def test_partition_filter_prunes(spark, tmp_path):
    rows = spark.range(4).select("id", F.concat(F.lit("2024-01-0"), (F.col("id") + 1).cast("string")).alias("dt"))
    write_layer(rows, "DWD", str(tmp_path / "t"))
    text = plan(layered.on_date(spark.read.schema(rows.schema).parquet(str(tmp_path / "t")), "2024-01-02"))
    assert "PartitionFilters: [isnotnull(dt" in text


def test_a_large_dimension_is_not_broadcast(spark):
    fact = spark.read.parquet(f"{DATA}/lineitem.parquet")
    dim = spark.read.parquet(f"{DATA}/part.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        text = plan(joins.enrich(fact, dim, {"l_partkey": "p_partkey"}, {"name": "p_name"}))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text


def test_neighbours_take_one_pass_and_four_shuffles(spark):
    df = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "ts", "event_id")
    out = windows.neighbours(df, ["user_id"], ["ts", "event_id"], {"before": "event_id"}, {"after": "event_id"})
    # One more deals the rows to the written ranges.
    assert len(re.findall(r"Exchange (?:hash|range|Single)", plan(out).split("== Initial Plan ==")[0])) <= 3
