"""Pareto lumping of rare items and attribute levels (W3, W4, W5, U3, PF23, AG19).

An item (or level) is lumped when the cumulative share of the metric, with
items sorted by the metric descending (ties by name), exceeds ``1 - share``;
the item that crosses the threshold is lumped too, so the kept items total at
most ``1 - share``. Only groups with more than ``min_levels`` items are
lumped. Sums are exact decimals and the threshold test is done without
division, so the decision is the same in any engine.

The cumulative sum is a distributed prefix sum over the *pre-aggregated*
items (one row per item), so no task has to hold a brand or a feature.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ITEM_COLS = ["case_size_range", "gender", "movement", "material", "dial_color", "strap_type",
             "strap_color", "precious_stone", "glass", "case_shape", "watch_type"]


def _dec(c: str):
    return F.coalesce(F.col(c).cast("decimal(38,8)"), F.lit(0).cast("decimal(38,8)"))


def item_pareto_mapping(df: DataFrame, share: float = 0.05, min_levels: int = 100,
                        group: str = "brand", item: str = "item_no", metric: str = "billing") -> DataFrame:
    """W3: per (brand, item) the metric total, cumulative share and lump flag."""
    per = df.groupBy(group, item).agg(F.sum(_dec(metric)).alias("metric_sum"))
    cum = _cumulative(per, group, item)
    keep = Decimal(1) - Decimal(str(share))
    # exact: decimal(30,8) * decimal(p,s) stays within 38 digits (no rounding)
    over = F.col("cum_sum") > F.col("total").cast("decimal(30,8)") * F.lit(keep)
    return cum.select(group, item, F.col("metric_sum").cast("double").alias("metric_sum"),
                      F.try_divide(F.col("cum_sum").cast("double"), F.col("total").cast("double")).alias("cum_share"),
                      "levels", (over & (F.col("levels") > min_levels)).alias("lumped"))


def _cumulative(per: DataFrame, group: str, item: str) -> DataFrame:
    """Exact running sums by metric descending, then item (null last), without a task per group.

    A range-partitioned sort on (group, metric desc, item) spreads a large
    group over many ordered partitions; the partition id is written together
    with the rows (so it is fixed), running sums are taken within each
    (partition, group) slice, and each slice adds the total of the earlier
    slices of its group (a small table: groups x partitions).
    """
    from ..session import materialize
    spark = per.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    order = [F.col(group), F.desc("metric_sum"), F.asc_nulls_last(item)]
    placed = materialize(per.repartitionByRange(n, *order).sortWithinPartitions(*order)
                            .withColumn("_pid", F.spark_partition_id()), "pareto-placed")
    w_local = (Window.partitionBy("_pid", group).orderBy(F.desc("metric_sum"), F.asc_nulls_last(item))
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = placed.withColumn("_local", F.sum("metric_sum").over(w_local))
    slices = placed.groupBy(group, "_pid").agg(F.sum("metric_sum").alias("_slice"), F.count("*").alias("_n"))
    w_prev = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (slices.withColumn("_offset", F.coalesce(F.sum("_slice").over(w_prev), F.lit(0).cast("decimal(38,8)")))
                     .withColumn("total", F.sum("_slice").over(Window.partitionBy(group)))
                     .withColumn("levels", F.sum("_n").over(Window.partitionBy(group)))
                     .select(F.col(group).alias("_of"), F.col("_pid").alias("_in"), "_offset", "total", "levels"))
    return (local.join(offsets, F.col(group).eqNullSafe(F.col("_of")) & (F.col("_pid") == F.col("_in")))
                 .select(group, item, "metric_sum",
                         # narrower operands keep the sum at scale 8 (38+38 digits would drop one)
                         (F.col("_local").cast("decimal(30,8)") + F.col("_offset").cast("decimal(30,8)"))
                         .cast("decimal(38,8)").alias("cum_sum"),
                         "total", "levels"))


def global_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG22: most frequent non-null value per column (ties → smallest), one row."""
    return df.agg(*[F.mode(F.col(c), deterministic=True).alias(f"_mode_{c}") for c in cols])


def apply_item_pareto(df: DataFrame, mapping: DataFrame, label: str = "Others", lump_brand: bool = True,
                      overwrite_attrs: list[str] | None = None, item: str = "item_no",
                      group: str = "brand", parts: int | None = None) -> DataFrame:
    """Replace lumped items by ``label`` (and their brand, as the source does);
    optionally set their attributes to the global mode of each attribute.
    ``parts``: ``df`` lies in so many hash partitions by ``item``."""
    # by item alone, with the groups in which it is lumped: rows that lie by item stay where they are
    m = mapping.where("lumped").groupBy(item).agg(F.collect_set(group).alias("_lumped_in"))
    if parts:
        m = m.repartition(parts, item)
    j = df.join(m.hint("shuffle_hash"), item, "left").withColumn("_orig_brand", F.col(group))
    lumped = F.coalesce(F.array_contains("_lumped_in", F.col(group)), F.lit(False))
    if overwrite_attrs:
        # one row: the most frequent value of each attribute, used as literals
        modes = global_modes(df, overwrite_attrs).head()
        types = dict(df.dtypes)
        for c in overwrite_attrs:
            j = j.withColumn(c, F.when(lumped, F.lit(modes[f"_mode_{c}"]).cast(types[c])).otherwise(F.col(c)))
    j = j.withColumn("_lumped", lumped).drop("_lumped_in")
    lumped = F.col("_lumped")
    j = j.withColumn(item, F.when(lumped, F.lit(label)).otherwise(F.col(item).cast("string")))
    if lump_brand:
        j = j.withColumn(group, F.when(F.col("_lumped"), F.lit(label)).otherwise(F.col(group)))
    return j


def item_pareto_report(lumped_rows: DataFrame, mapping: DataFrame, group: str = "brand") -> DataFrame:
    """Per brand: items before / after, and the lumped share of billing and sales quantity (%)."""
    orig = mapping.groupBy(group).agg(
        F.count("*").alias("orig_sku_count"),
        (F.count(F.when(~F.col("lumped"), 1)) + F.max(F.col("lumped").cast("int"))).alias("new_sku_count"))
    rows = (lumped_rows.groupBy(F.col("_orig_brand").alias(group))
            .agg(F.sum(F.when(F.col("_lumped"), _dec("billing"))).alias("ob"), F.sum(_dec("billing")).alias("tb"),
                 F.sum(F.when(F.col("_lumped"), _dec("sales_quantity"))).alias("oq"),
                 F.sum(_dec("sales_quantity")).alias("tq")))

    def pct(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double") * 100, F.col(b).cast("double")), F.lit(0.0))

    return orig.join(rows, group).select(group, "orig_sku_count", "new_sku_count",
                                         pct("ob", "tb").alias("other_billing_pct"),
                                         pct("oq", "tq").alias("other_sales_qty_pct"))


def feature_pareto_mapping(df: DataFrame, cols: list[str], share: float = 0.10, min_levels: int = 10,
                           metric: str = "billing") -> DataFrame:
    """W4: per (feature, level) the metric total, cumulative share and lump flag.

    The columns are unpivoted into (feature, level, metric) and aggregated in
    one pass; running sums per feature mark the tail.
    NULL is a level of its own for the counts and sums but is never renamed.
    """
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level"), _dec(metric).alias("m"))
        for c in cols])).alias("s")).select("s.*")
    per = stacked.groupBy("feature", "level").agg(F.sum("m").alias("metric_sum"))
    per = _cumulative(per, "feature", "level")
    keep = Decimal(1) - Decimal(str(share))
    # exact: decimal(30,8) * decimal(p,s) stays within 38 digits (no rounding)
    over = F.col("cum_sum") > F.col("total").cast("decimal(30,8)") * F.lit(keep)
    return per.select("feature", "level", F.col("metric_sum").cast("double").alias("metric_sum"),
                      F.try_divide(F.col("cum_sum").cast("double"), F.col("total").cast("double")).alias("cum_share"),
                      "levels", (over & (F.col("levels") > min_levels) & F.col("level").isNotNull()).alias("lumped"))


def apply_feature_pareto(df: DataFrame, mapping: DataFrame, cols: list[str], label: str = "Other") -> DataFrame:
    """PF23: replace lumped levels by ``label`` (one join per column against
    the lumped levels of that column; AQE broadcasts them where they are small)."""
    out = df
    for c in cols:
        m = (mapping.where((F.col("feature") == c) & F.col("lumped"))
                    .select(F.col("level").alias(f"_lv_{c}"), F.lit(True).alias(f"_hit_{c}")))
        out = out.join(m, F.col(c).cast("string") == F.col(f"_lv_{c}"), "left")
        out = out.withColumn(c, F.when(F.col(f"_hit_{c}"), F.lit(label)).otherwise(F.col(c).cast("string"))) \
                 .drop(f"_lv_{c}", f"_hit_{c}")
    return out


def feature_pareto_report(df: DataFrame, mapping: DataFrame, cols: list[str]) -> DataFrame:
    """Per feature: levels before / after and the lumped share of billing and sales quantity."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level"), _dec("billing").alias("b"),
                 _dec("sales_quantity").alias("q")) for c in cols])).alias("s")).select("s.*")
    lm = mapping.select("feature", "level", "lumped")
    j = stacked.join(lm, ["feature", "level"], "left")
    hit = F.coalesce(F.col("lumped"), F.lit(False))
    g = j.groupBy("feature").agg(
        F.sum(F.when(hit, F.col("b"))).alias("ob"), F.sum("b").alias("tb"),
        F.sum(F.when(hit, F.col("q"))).alias("oq"), F.sum("q").alias("tq"))
    lv = mapping.groupBy("feature").agg(
        F.count("*").alias("orig_levels"),
        (F.count(F.when(~F.col("lumped"), 1)) + F.max(F.col("lumped").cast("int"))).alias("new_levels"))

    def pct(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double") * 100, F.col(b).cast("double")), F.lit(0.0))

    return lv.join(g, "feature").select(F.upper("feature").alias("feature"), "orig_levels", "new_levels",
                                        pct("ob", "tb").alias("other_billing_pct"),
                                        pct("oq", "tq").alias("other_sales_qty_pct"))
