"""The demand chain lies by item: its wide rows are shuffled once, and its shortcuts give the rows of the long way."""

from decimal import Decimal

from pyspark.sql import functions as F

import __spark_entry__ as E
from tillroll.operators import share as SH
from tillroll.operators.pareto import apply_item_pareto
from tillroll.sources.testdata import MONEY, UNITS


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_kept_by_item_are_not_shuffled(spark, sf):
    assert "Exchange" not in _plan(E.queries()["unique_skus"](spark, sf))
    plan = _plan(E.queries()["log_share_b"](spark, sf))
    assert "hashpartitioning(state" not in plan and "SortMergeJoin" not in plan


def test_money_in_whole_units_equals_the_decimals(spark):
    rows = [(Decimal(p), Decimal(d), Decimal(t)) for p in ("0.00", "0.01", "903.37", "104949.50", "9999999999.99", "-17.05")
            for d in ("0.00", "0.07", "0.10") for t in ("0.00", "0.08")] + [(None, Decimal("0.05"), None), (Decimal("5.55"), None, None)]
    df = spark.createDataFrame(rows, "l_extendedprice decimal(12,2), l_discount decimal(4,2), l_tax decimal(4,2)")
    df = df.selectExpr("*", *[f"cast(round(cast({c} as double) * 100) as bigint) AS {k}"
                              for k, c in (("p", "l_extendedprice"), ("dr", "l_discount"), ("tr", "l_tax"))])
    assert set(MONEY) == set(UNITS)
    for k in MONEY:
        both = df.selectExpr(f"cast({MONEY[k]} as double) AS a", f"cast({UNITS[k]} as double) / 10000 AS b").collect()
        assert all(r["a"] == r["b"] for r in both), k


def test_rows_alone_in_their_group_need_no_grouping(spark):
    rows = [(f"T{i % 2}", None if i == 7 else i, i % 3, f"S{i % 4}", "x" if i % 5 else None, i - 3, None if i % 4 == 0 else i * -1.23456789)
            for i in range(40)]
    df = spark.createDataFrame(rows, "store_type string, item_no long, period int, state string, brand string, quantity long, billing double")
    df = df.withColumn("_lumped", F.coalesce(F.col("item_no") % 3 == 0, F.lit(False)))
    df = df.withColumn("item_no", F.when(F.col("_lumped"), "Others").otherwise(F.col("item_no").cast("string")))
    scale = {"billing": 10000}
    want = SH.regroup_lumped(df, scale=scale).collect()
    got = SH.regroup_lumped(df, scale=scale, alone=~F.col("_lumped"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want))
    assert len(want) < 40


def test_an_item_is_lumped_in_its_own_brands_only(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 2.0), (None, 1, 3.0), ("a", 2, 4.0), ("a", None, 5.0)], "brand string, item_no long, v double")
    mapping = spark.createDataFrame([("a", 1, True), ("b", 1, False), (None, 1, True), ("a", None, True)], "brand string, item_no long, lumped boolean")
    for parts in (None, 3):
        out = {r["v"]: (r["item_no"], r["brand"], r["_lumped"], r["_orig_brand"]) for r in apply_item_pareto(df, mapping, parts=parts).collect()}
        assert out == {1.0: ("Others", "Others", True, "a"), 2.0: ("1", "b", False, "b"), 3.0: ("1", None, False, None),
                       4.0: ("2", "a", False, "a"), 5.0: (None, "a", False, "a")}
