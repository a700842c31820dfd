"""Demand frame and log market-share target (AG18, AG19, PF19, FE1-FE3, SC10, SC11, J19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import first_value, mean, mean_of_one
from .codes import rolled

MEAN_COLS = ["quantity", "purchase_quantity", "transfer_quantity", "available_quantity", "sales_quantity",
             "purchase_cost_amount", "purchase_mrp", "stock_prevailing_mrp", "transfer_cost_amount",
             "days_to_sell", "num_of_customers", "total_price", "line_discount", "crm_line_discount",
             "discount", "tax", "cost", "billing", "contribution", "trade_incentive", "trade_incentive_value",
             "total_contribution", "case_size"]
FIRST_COLS = ["brand", "store_location", "city_type", "region", "purchase_date", "store_in",
              "product_group_code", "sales_department", "case_size_range", "gender", "movement", "material",
              "dial_color", "strap_type", "strap_color", "precious_stone", "glass", "case_shape", "watch_type",
              "area_code"]
SCALED = {"stock_prevailing_mrp": 10000, "billing": 10000}


def regroup_lumped(df: DataFrame, keys=("store_type", "item_no", "period", "state"),
                   scale: dict[str, int] | None = None, alone: Column | None = None) -> DataFrame:
    """AG19 + PF19: one row per (store type, item, period, state) after
    lumping: numbers averaged, attributes take one value; money columns are
    then rescaled (divided by 1e4).

    ``alone`` marks rows that are known to be the only one of their group: they are not grouped, hence not shuffled."""
    scale = SCALED if scale is None else scale
    firsts, means = ([c for c in cols if c in df.columns] for cols in (FIRST_COLS, MEAN_COLS))

    def grouped(rows):
        return rows.groupBy(*keys).agg(*[first_value(c).alias(c) for c in firsts], *[mean(c).alias(c) for c in means])

    if alone is None:
        g = grouped(df)
    else:
        text = [c for c, kind in df.dtypes if kind == "string" and c in firsts]
        g = df.where(alone).select(*keys, *firsts, *[mean_of_one(c).alias(c) for c in means]).unionByName(
            rolled(df.where(~alone), grouped, text))
    for c, k in scale.items():
        g = g.withColumn(c, F.col(c) / F.lit(float(k)))
    return g


def market_sizes(df: DataFrame, market_share: DataFrame, unit: str = "store_type") -> DataFrame:
    """FE1: market size per (state, period) = sales / state share, and per
    store (type) = size / number of distinct store types (stores) there."""
    sales = df.groupBy("state", "period").agg(
        F.sum(F.col("sales_quantity").cast("decimal(38,8)")).cast("double").alias("sales_quantity"),
        F.count_distinct(unit).alias("store_numbers"))
    j = sales.join(market_share, "state", "left")
    size = F.try_divide(F.col("sales_quantity"), F.col("market_share"))
    return j.select("state", "period", "sales_quantity", "market_share", size.alias("market_size"),
                    "store_numbers",
                    F.try_divide(size, F.col("store_numbers").cast("double")).alias("per_store_market"))


def log_share(df: DataFrame, sizes: DataFrame, variant: str = "B", zero: float = 1e-5) -> DataFrame:
    """FE2 / FE3: ``so = per_store_market - s``; rows with ``so`` NULL or 0 are
    dropped; variant B: ``r = s / so`` with 0 → ``zero``; variant A:
    ``r = (s == 0 ? zero : s) / so``. The target is ``ln r``; rows without a finite one (PF20) are dropped."""
    # one row per state and period, so a broadcast of bounded size
    j = df.join(F.broadcast(sizes.select("state", "period", "per_store_market")), ["state", "period"], "inner")
    so = F.col("per_store_market") - F.col("sales_quantity")
    j = j.withColumn("so", so).where(F.col("so").isNotNull() & (F.col("so") != 0))
    if variant == "B":
        r = F.try_divide("sales_quantity", "so")
        r = F.when(r == 0, F.lit(zero)).otherwise(r)
    else:
        s = F.when(F.col("sales_quantity") == 0, F.lit(zero)).otherwise(F.col("sales_quantity"))
        r = F.try_divide(s, F.col("so"))
    return j.where((r > 0) & (r < float("inf"))).withColumn("log_share", F.ln(r)).drop("so")
