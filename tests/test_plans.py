"""Plan-level checks: the shapes that matter at scale."""

import pytest

import __spark_entry__ as E

SCALE_QUERIES = ["weekly_summary", "weekly_cells", "interval_summary", "period_rollup_store", "weekly_grid",
                 "returns_matching", "null_impact_report", "fuzzy_levels", "store_type_frequency",
                 "sales_after_stock_window", "full_assortment_demand"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SCALE_QUERIES)
def test_no_cartesian_or_nested_loop(spark, sf, name):
    plan = _plan(E.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_weekly_merge_is_one_aggregate_not_three_joins(spark, sf):
    plan = _plan(E.queries()["weekly_cells"](spark, sf))
    assert "SortMergeJoin" not in plan and "FullOuter" not in plan


def test_interval_has_no_range_join(spark, sf):
    plan = _plan(E.queries()["interval_summary"](spark, sf))
    assert "FullOuter" not in plan


def test_scan_prunes_columns_and_pushes_filters(spark, sf):
    from pyspark.sql import functions as F
    from tillroll.sources.testdata import RetailTables
    t = RetailTables(spark, sf)
    df = t.base("supplier").where(F.col("s_suppkey") < 10).select("s_suppkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(s_suppkey), LessThan(s_suppkey,10)]" in plan
    assert "ReadSchema: struct<s_suppkey:bigint>" in plan


def test_role_tables_read_only_their_partition(spark, sf):
    from tillroll.sources.testdata import RetailTables
    plan = _plan(RetailTables(spark, sf).sales_raw)
    assert "PartitionFilters: [isnotnull(role" in plan and "(role" in plan
