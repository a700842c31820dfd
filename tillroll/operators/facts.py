"""Cleaning and first-level aggregation of the four transaction facts (PF1-PF3, AG1-AG3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import first_value, mean, total
from ..functions.fiscal import stock_week_label

SALES_MONEY = ["price", "total_price", "line_discount", "crm_line_discount", "discount", "tax",
               "cost", "billing", "contribution", "trade_incentive", "trade_incentive_value",
               "total_contribution"]


def closing_stock(raw: DataFrame, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """AG1 + SC2: stock per (item, location, closing date, and ``extra_keys``) with its opening-week label."""
    return (raw.where(F.col("closing_date").isNotNull())
               .groupBy("item_no", "location_code", "closing_date", *extra_keys)
               .agg(first_value("brand").alias("brand"),
                    first_value("department").alias("department"),
                    total("quantity").alias("quantity"),
                    mean("cost_amount").alias("cost_amount"),
                    mean("purchase_mrp").alias("purchase_mrp"),
                    mean("stock_prevailing_mrp").alias("stock_prevailing_mrp"),
                    first_value("purchase_date").alias("purchase_date"),
                    first_value("state").alias("state"),
                    first_value("region").alias("region"))
               .withColumn("week", stock_week_label("closing_date")))


def sales_daily(raw: DataFrame, min_qty: int | None = 0, max_qty: int | None = 2) -> DataFrame:
    """PF2/PF3 + AG2: sales lines to (location, date, item, customer).

    The quantity guard keeps ``min_qty <= q < max_qty`` per line (the weekly
    summary drops returns and bulk lines); ``None`` disables a bound.
    """
    cond = F.col("sales_date").isNotNull()
    if min_qty is not None:
        cond &= F.col("quantity") >= min_qty
    if max_qty is not None:
        cond &= F.col("quantity") < max_qty
    return (raw.where(cond)
               .groupBy("location_code", "sales_date", "item_no", "customer_no")
               .agg(first_value("brand").alias("brand"),
                    first_value("sales_department").alias("sales_department"),
                    total("quantity").alias("quantity"),
                    *[mean(c).alias(c) for c in SALES_MONEY],
                    first_value("receipt_date").alias("receipt_date"),
                    first_value("state").alias("state"),
                    first_value("region").alias("region")))


def purchase_daily(raw: DataFrame) -> DataFrame:
    """AG3: purchases to (location, posting date, item)."""
    return (raw.where(F.col("posting_date").isNotNull())
               .groupBy("location_code", "posting_date", "item_no")
               .agg(first_value("brand").alias("brand"),
                    first_value("department").alias("department"),
                    total("quantity").alias("quantity"),
                    mean("purchase_mrp").alias("purchase_mrp"),
                    mean("cost_amount").alias("cost_amount"),
                    first_value("state_code").alias("state_code"),
                    first_value("region").alias("region")))


def transfers(raw: DataFrame) -> DataFrame:
    """Transfers with a known arrival date (no aggregation at this level)."""
    return raw.where(F.col("store_in_date").isNotNull())
