"""Levels of one side only, from one pass over either frame."""

from pyspark.sql import functions as F

from tillroll.operators import features as FE


def test_sides_and_null_levels(spark):
    a = spark.createDataFrame([("x", 1, None), ("y", 2, "p"), ("x", 3, "q")], "f string, g int, h string")
    b = spark.createDataFrame([("x", 2, None), ("z", 2, "p")], "f string, g int, h string")
    got = sorted((r.feature, r.level or "", r.side) for r in FE.level_alignment(a, b, ["f", "g", "h"]).collect())
    assert got == sorted([("f", "y", "train_only"), ("f", "z", "score_only"), ("g", "1", "train_only"), ("g", "3", "train_only"),
                          ("h", "", "train_only"), ("h", "", "score_only"), ("h", "q", "train_only")])


def test_frames_are_read_once_and_joined_once(spark, tmp_path):
    spark.range(50).select("id", (F.col("id") % 7).alias("f"), (F.col("id") % 3).alias("g")).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    df = FE.level_alignment(t, t.join(t.select("id").distinct(), "id"), ["f", "g"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 0 and plan.count("FileScan") == 3 and plan.count("BroadcastExchange") <= 1
