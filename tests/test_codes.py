"""Roll-ups carry text as codes: same results, hash aggregation in the plans."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tillroll.operators import codes as C


@pytest.mark.parametrize("name", ["sales_weekly", "closing_stock_weekly", "purchase_weekly", "transfer_weekly", "weekly_cells",
                                  "weekly_summary", "period_rollup_store", "period_rollup_store_type", "interval_summary"])
def test_no_sort_aggregate(spark, sf, name):
    plan = E.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_codes_keep_order_nulls_and_long_lists(spark, monkeypatch):
    rows = [(i % 3, None if i % 5 == 0 else f"ÄbZ"[i % 3] + str(i % 4), f"v{i}", None, "only" if i % 3 == 1 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, a string, b string, c string, d string")
    f = lambda x: x.groupBy("k").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c"), F.min("d").alias("d"))
    want = sorted(map(repr, f(df).collect()))
    assert sorted(map(repr, C.rolled(df, f, ["a", "b", "c", "d"]).collect())) == want
    monkeypatch.setattr(C, "MOST", 20)
    codes = C.Codes.of([df, df.select("a")], ["a", "b", "c", "d"])
    assert set(codes.levels) == {"a", "c", "d"} and codes.levels["a"] == sorted(codes.levels["a"])
    assert sorted(map(repr, C.rolled(df, f, ["a", "b", "c", "d"]).collect())) == want
    assert C.rolled(df.where("false"), f, ["a", "b", "c", "d"]).count() == 0
