"""Per-week item-store grid (the stock-file-per-week variant of the summary):
SE3, J10, J11, J12, J22, AG10, AG12, AG13, PF13, PF17, DQ7.

For every stock week ``W`` the grid is the union of (store, item) pairs seen
in that week's stock and in sales of ``(W, W + 7]``; stock, sales, billing,
days-to-sell and purchases of the window are attached, store and item
attributes are inner-joined, and a corporate-order flag marks pairs that had
a customer-day quantity above 2. All weeks are done in one job: the half-open
windows become an equi-join through a broadcast day → week map.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import MEAN_SCALE, units_sql


def week_day_map(weeks: DataFrame, date_col: str = "week", days: int = 7) -> DataFrame:
    """(day, week) for the days of each ``(week, week + days]`` window; errors on overlap."""
    d = weeks.select(F.col(date_col).alias("_w"),
                     F.explode(F.sequence(F.date_add(date_col, 1), F.date_add(date_col, days))).alias("_day"))
    dup = F.count("*").over(Window.partitionBy("_day"))
    return d.select("_day", F.when(dup > 1, F.raise_error(F.lit("week windows overlap")))
                    .otherwise(F.col("_w")).alias("_w"))


def customer_day_quantity(sales_raw: DataFrame, qty_col: str = "quantity") -> DataFrame:
    """AG13 + PF17: quantity per (store, date, item, customer) and the bulk flag (> 2)."""
    return (sales_raw.groupBy("location_code", "sales_date", "item_no", "customer_no")
            .agg(F.sum(qty_col).alias("customer_day_quantity"))
            .withColumn("corporate_order", F.when(F.col("customer_day_quantity") > 2, 1).otherwise(0)))


def _u(c):
    return F.expr(units_sql(c))


def _fm(u, n):
    return F.expr(f"cast(CASE WHEN {u} < 0 THEN -((-{u} * 2 + {n}) div nullif(2 * {n}, 0)) "
                  f"ELSE ({u} * 2 + {n}) div nullif(2 * {n}, 0) END as double) / {MEAN_SCALE}")


def weekly_grid(stock_raw: DataFrame, sales_raw: DataFrame, purchase_raw: DataFrame,
                store_master: DataFrame, item_master: DataFrame,
                corp_qty_col: str = "raw_quantity") -> DataFrame:
    stock = stock_raw.where(F.col("closing_date").isNotNull())
    weeks = stock.select(F.col("closing_date").alias("week")).distinct()
    dm = F.broadcast(week_day_map(weeks))
    # the customer-day flag needs whole days, so it is computed before tagging
    corp = customer_day_quantity(sales_raw, corp_qty_col)
    s = (corp.join(dm, corp.sales_date == dm._day)
             .select("location_code", "item_no", F.col("_w").alias("week"),
                     F.col("corporate_order").alias("_corp")))
    x = (sales_raw.join(dm, sales_raw.sales_date == dm._day)
         .select("location_code", "item_no", F.col("_w").alias("week"),
                 F.lit(1).alias("_has_sales"), F.col("quantity").alias("_sq"),
                 F.datediff("sales_date", "receipt_date").alias("_dts"),
                 _u("billing").alias("_bill_u"), F.col("billing").alias("_bill_v")))
    p = (purchase_raw.join(dm, purchase_raw.posting_date == dm._day)
         .select("location_code", "item_no", F.col("_w").alias("week"), F.col("quantity").alias("_pq")))
    st = stock.select("location_code", "item_no", F.col("closing_date").alias("week"),
                      F.lit(1).alias("_has_stock"), F.col("quantity").alias("_stq"),
                      _u("purchase_mrp").alias("_pmrp_u"), F.col("purchase_mrp").alias("_pmrp_v"),
                      _u("stock_prevailing_mrp").alias("_spm_u"),
                      F.col("stock_prevailing_mrp").alias("_spm_v"),
                      F.col("state").alias("_state"), F.col("region").alias("_region"),
                      F.datediff("closing_date", "purchase_date").alias("_dis"))
    u = (st.unionByName(x, allowMissingColumns=True).unionByName(s, allowMissingColumns=True)
           .unionByName(p, allowMissingColumns=True))
    g = (u.groupBy("location_code", "item_no", "week")
          .agg(F.max("_has_stock").alias("_has_stock"), F.max("_has_sales").alias("_has_sales"),
               F.sum("_stq").alias("stock_quantity"),
               F.sum("_pmrp_u").alias("_pmrp_u"), F.count("_pmrp_v").alias("_pmrp_n"),
               F.sum("_spm_u").alias("_spm_u"), F.count("_spm_v").alias("_spm_n"),
               F.min("_state").alias("state"), F.min("_region").alias("region"),
               F.sum("_dis").alias("_dis_s"), F.count("_dis").alias("_dis_n"),
               F.max("_corp").alias("corporate_order"),
               F.sum("_sq").alias("sales_quantity"),
               F.sum("_dts").alias("_dts_s"), F.count("_dts").alias("_dts_n"),
               F.sum("_bill_u").alias("_bill_u"), F.count("_bill_v").alias("_bill_n"),
               F.sum("_pq").alias("purchase_quantity"))
          .where((F.col("_has_stock") == 1) | (F.col("_has_sales") == 1)))
    scale = MEAN_SCALE
    g = g.select(
        F.concat_ws("_", F.col("item_no").cast("string"), "location_code").alias("col_pk"),
        "item_no", "location_code", "week", F.month("week").alias("month"), F.year("week").alias("year"),
        F.coalesce(F.col("stock_quantity"), F.lit(0)).cast("bigint").alias("stock_quantity"),
        _fm("_pmrp_u", "_pmrp_n").alias("purchase_mrp"),
        _fm("_spm_u", "_spm_n").alias("stock_prevailing_mrp"), "state", "region",
        _fm(f"(_dis_s * {scale})", "_dis_n").alias("days_in_stock_agg"),
        F.coalesce("corporate_order", F.lit(0)).alias("corporate_order"),
        F.coalesce(F.col("sales_quantity"), F.lit(0)).cast("bigint").alias("sales_quantity"),
        F.coalesce(_fm(f"(_dts_s * {scale})", "_dts_n"), F.lit(0.0)).alias("days_to_sell"),
        F.coalesce(_fm("_bill_u", "_bill_n"), F.lit(0.0)).alias("avg_billing"),
        F.coalesce(F.col("purchase_quantity"), F.lit(0)).cast("bigint").alias("purchase_quantity"))
    g = g.withColumn("total_available_qty", F.col("stock_quantity") + F.col("purchase_quantity"))
    stores = store_master.select(F.col("store_code").alias("location_code"), "store_type",
                                 "store_location", "city_type")
    items = item_master.select("item_no", "case_size", "case_size_range", "gender", "movement",
                               "material", "dial_color", "strap_type", "strap_color",
                               "precious_stone", "glass", "case_shape", "watch_type")
    return g.join(stores, "location_code", "inner").join(items, "item_no", "inner")
