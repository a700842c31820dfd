"""Exact weighted cuts of many groups at once, by histograms of a sortable key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

STEP = 21


def weighted_cuts(rows: DataFrame, targets: DataFrame, group: list[str], key: Column, weight: Column,
                  rounds: int) -> DataFrame:
    """The key at which each group's running weight first exceeds its target.

    ``rows`` are the weighted rows, ``targets`` has one row per group with the
    columns ``group`` and ``target`` (long). ``key`` is a long of ``21 * rounds``
    bits. Returns ``group + [cut, below, at]``: ``cut`` is the largest key such
    that the rows with a smaller key weigh ``target`` at most, ``below`` is what
    these rows weigh and ``at`` the weight of the rows on the cut. A group that
    weighs no more than its target gets a cut above all keys.

    One round fixes 21 bits: the rows that share the bits fixed so far are summed
    by the next 21 bits (combined before the shuffle, so hot groups and keys cost
    one row a task), and a running sum over a group's sums - two million at most -
    finds the bits in which the target falls. No group is sorted or gathered.
    """
    rows = rows.select(*group, key.alias("_key"), weight.cast("long").alias("_w"))
    state = targets.select(*group, F.col("target").cast("long").alias("target"),
                           F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    up_to = Window.partitionBy(*group).orderBy("_next").rowsBetween(Window.unboundedPreceding, 0)
    light = None
    for r in range(rounds):
        shift = STEP * (rounds - 1 - r)
        high = F.lit(0).cast("long") if r == 0 else F.shiftright("_key", shift + STEP)
        sums = (rows.join(state, group).where(high == F.col("prefix"))
                .groupBy(*group, F.shiftright("_key", shift).alias("_next"))
                .agg(F.sum("_w").alias("_w"), F.max("target").alias("target"), F.max("below").alias("below"))
                .withColumn("_to", F.sum("_w").over(up_to)))
        over = F.when(F.col("below") + F.col("_to") > F.col("target"), F.col("_next"))
        found = checkpointed(sums.groupBy(*group).agg(
            F.max("target").alias("target"), F.max("below").alias("before"), F.max("_to").alias("all"),
            F.min_by(F.struct("_next", (F.col("_to") - F.col("_w")).alias("less"), "_w"), over).alias("hit")), "cuts")
        light = found.where("hit is null").select(*group, "all") if r == 0 else light
        state = found.where("hit is not null").select(
            *group, "target", F.col("hit._next").alias("prefix"), (F.col("before") + F.col("hit.less")).alias("below"),
            F.col("hit._w").alias("at"))
        if r < rounds - 1:
            state = state.drop("at")
    return (targets.select(*group).join(state.drop("target"), group, "left").join(light, group, "left")
            .select(*group, F.coalesce("prefix", F.lit(2 ** 63 - 1)).alias("cut"),
                    F.coalesce("below", "all", F.lit(0)).alias("below"), F.coalesce("at", F.lit(0)).alias("at")))
