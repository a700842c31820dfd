"""Exact selections against sorting, oversampling to the row, ordered splits of rows."""

import pytest
from pyspark.sql import functions as F

from tillroll.operators import features as FE
from tillroll.operators.selection import row_hash, with_first


@pytest.mark.parametrize("step", [15, 3])
def test_first_rows(spark, monkeypatch, step):
    monkeypatch.setattr("tillroll.operators.selection.STEP", step)
    df = spark.range(500).withColumn("h", row_hash(1, ["id"]))
    order = [r.id for r in sorted(df.collect(), key=lambda r: r.h)]
    for k in (0, 1, 137, 500, 600):
        got = {r.id for r in with_first(df, "h", k, ["id"], "first").where("first").collect()}
        assert got == set(order[:k])


def test_equal_hashes_are_cut_by_the_ties(spark):
    df = spark.range(50).withColumn("h", F.when(F.col("id") < 40, 7).otherwise(F.col("id")).cast("long"))
    got = sorted(r.id for r in with_first(df, "h", 12, ["id"], "first").where("first").collect())
    assert got == list(range(12))
    assert with_first(df, "h", 12, ["id"], "first").count() == 50


def test_oversampling_is_exact(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, 1).when(F.col("id") % 10 == 3, 2).otherwise(0).alias("c"))
    sizes = {r.c: r.n for r in df.groupBy("c").agg(F.count("*").alias("n")).collect()}
    got = FE.oversample(df, "c", ["id"])
    copies = got.groupBy("c", "id").agg(F.count("*").alias("n")).collect()
    assert {r.c: r.n for r in got.groupBy("c").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(sizes, max(sizes.values()))
    for c, n in sizes.items():
        own = [r.n for r in copies if r.c == c]
        assert len(own) == n and max(own) - min(own) <= 1
    one = df.where("c = 0")
    assert FE.oversample(one, "c", ["id"]).count() == one.count()


def test_ordered_split_cuts_rows_not_periods(spark):
    df = spark.range(30).select("id", (F.col("id") % 3).alias("period"))
    got = FE.ordered_split(df, ["id"], 0.2)
    assert got.count() == 30
    train, test = got.where("is_train"), got.where("not is_train")
    assert (train.count(), test.count()) == (24, 6) and {r.period for r in test.collect()} == {2}
    assert [r.id for r in FE.ordered_split(df.where("id < 3"), ["id"], 0.5).where("not is_train").collect()] == [2]
    odd = df.withColumn("period", F.when(F.col("id") > 3, F.col("period")))
    assert FE.ordered_split(odd, ["id"], 0.9).where("is_train").where("period is null").count() == 3
    assert FE.ordered_split(df.where("false"), ["id"]).count() == 0
