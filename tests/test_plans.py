"""Physical plan checks: pushdown, pruning, partial aggregation, no Python UDFs."""

import re

import pytest

from changeflow.plans.registry import QUERIES
from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"stream_changes", "stream_dedup"}))
def test_final_plans_stay_jvm_side_and_keyed(spark, name):
    plan = _final_plan(QUERIES[name](spark, SF_SMALL))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "BroadcastNestedLoopJoin", "CartesianProduct"):
        assert bad not in plan, bad


def test_status_filter_reaches_the_scan(spark):
    plan = _plan(QUERIES["orders_by_status"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan


def test_range_filter_reaches_the_scan(spark):
    plan = _plan(QUERIES["orders_in_range"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_projection_is_pruned(spark):
    plan = _plan(QUERIES["check_length"](spark, SF_SMALL))
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan


def test_net_changes_aggregates_partially(spark):
    plan = _plan(QUERIES["net_changes"](spark, SF_SMALL))
    assert "partial_min_by" in plan and "partial_max_by" in plan


def test_dimension_lookup_broadcasts_only_small_sides(spark):
    plan = _plan(QUERIES["fk_lookup"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan


def test_include_list_prunes_landed_partitions(spark, scratch):
    from changeflow import operators as op
    from changeflow.streaming import changes as S

    out = S.stream_events_to_files(spark, SF_SMALL, scratch)
    df = op.include_tables(spark.read.parquet(out), ["public.inventory_logs"])
    plan = _plan(df)
    assert re.search(r"PartitionFilters: \[isnotnull\(table#\d+\), \(table#\d+ = public.inventory_logs\)\]", plan)
    assert df.count() == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()


def test_nested_field_filter_prunes_nested_columns(spark, scratch):
    from pyspark.sql import functions as F

    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    c = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    docs = o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey", F.struct(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"),
                               F.col("c_mktsegment").alias("segment")).alias("user"))
    docs.write.parquet(f"{scratch}/docs")
    q = spark.read.parquet(f"{scratch}/docs").filter(F.col("user.user_id") == 7).select("o_orderkey")
    plan = _plan(q)
    assert "ReadSchema: struct<o_orderkey:bigint,user:struct<user_id:bigint>>" in plan
    assert "PushedFilters: [IsNotNull(user.user_id), EqualTo(user.user_id,7)]" in plan


def test_nest_shuffles_once_on_the_key(spark):
    plan = _final_plan(QUERIES["nest_items"](spark, SF_SMALL))
    assert len(re.findall(r"Exchange hashpartitioning\(l_orderkey#\d+L, \d+", plan)) == 1
    assert "partial_collect_list" in plan


def test_assign_ids_has_no_window_over_the_rows(spark):
    plan = _final_plan(QUERIES["assign_ids"](spark, SF_SMALL))
    # The rows were range-partitioned once and written; what is left reads them and joins the counts.
    assert "rangepartitioning" not in plan and "/assign_ids-" in plan
    # The only window runs over the per-partition counts (one row per partition).
    for line in plan.split("\n"):
        if "Window [" in line:
            assert "_cnt" in line


def test_totals_aggregate_partially_before_the_join(spark):
    plan = _final_plan(QUERIES["reconcile_totals"](spark, SF_SMALL))
    assert "partial_sum" in plan
    assert plan.index("Join") < plan.index("partial_sum")  # the join sits above the partial aggregate


def test_log_reuses_the_shared_version_shuffle(spark):
    plan = _final_plan(QUERIES["net_changes"](spark, SF_SMALL))
    assert "ReusedExchange" in plan
