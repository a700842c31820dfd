from decimal import Decimal

from pyspark.sql import functions as F

from tillroll.functions.aggregates import mean


def test_half_up_and_negative(spark):
    rows = [("a", Decimal("0.00000001")), ("a", Decimal("0.00000002")),   # 1.5e-8 -> 2e-8
            ("b", Decimal("-0.00000001")), ("b", Decimal("-0.00000002")),  # -1.5e-8 -> -2e-8
            ("c", None), ("d", Decimal("1.2345"))]
    df = spark.createDataFrame(rows, "k string, x decimal(18,8)")
    got = {r.k: r.m for r in df.groupBy("k").agg(mean("x").alias("m")).collect()}
    assert got["a"] == 2e-8 and got["b"] == -2e-8 and got["c"] is None and got["d"] == 1.2345


def test_partitioning_does_not_change_result(spark):
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("k"),
                                     (F.col("id") * 0.3333 + 0.0001).cast("decimal(18,4)").alias("x"))
    a = sorted(df.repartition(1).groupBy("k").agg(mean("x").alias("m")).collect())
    b = sorted(df.repartition(13).groupBy("k").agg(mean("x").alias("m")).collect())
    assert a == b


def test_mean_of_means_stays_exact(spark):
    df = spark.createDataFrame([(1, 1, Decimal("1.0001")), (1, 1, Decimal("1.0002")), (1, 2, Decimal("3.0000"))],
                               "g int, h int, x decimal(18,4)")
    lvl1 = df.groupBy("g", "h").agg(mean("x").alias("m"))
    lvl2 = lvl1.groupBy("g").agg(mean("m").alias("m")).head().m
    assert abs(lvl2 - (1.00015 + 3.0) / 2) < 1e-8
