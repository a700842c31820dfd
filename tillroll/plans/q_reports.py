"""Cleaning from text, ad-hoc tallies, top-k reports and the SQL-on-views path."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.aggregates import mean_sql
from ..operators import facts
from ..operators import grid
from ..operators.cleaning import clean_sales_text, sales_as_text
from ..operators.weekly import WeeklySummary
from ..sources.testdata import RetailTables
from . import sql_demand as SD
from . import sql_quality as SQ
from . import sql_weekly as W
from .catalog import query
from .q_demand import ARGS, DemandChain

QTY = ["quantity", "purchase_quantity", "transfer_quantity", "sales_quantity", "available_quantity"]


@query("cleaned_sales_daily", ids="PF1 PF2 PF3 SC5 SC9 IO5",
       sql=lambda: W.fact_ctes() + "\nSELECT * FROM sales")
def q_cleaned(spark, sf_dir):
    """Typed lines → text extract → cleaned lines → daily sales: equals the typed path."""
    t = RetailTables(spark, sf_dir)
    return facts.sales_daily(clean_sales_text(sales_as_text(t.sales_raw)))


def _tally_sql(where: str, key: str) -> str:
    sums = ", ".join(f"cast(sum({c}) as bigint) AS {c}" for c in QTY)
    return W.summary_ctes() + f"\nSELECT {key}, {sums} FROM summary {where} GROUP BY {key}"


def _tally(df, key):
    return df.groupBy(key).agg(*[F.sum(c).cast("bigint").alias(c) for c in QTY])


@query("week52_tally", ids="PF12 AG15", sql=lambda: _tally_sql("WHERE week LIKE 'W52-%'", "week"))
def q_w52(spark, sf_dir):
    s = WeeklySummary(RetailTables(spark, sf_dir)).summary()
    return _tally(s.where(F.col("week").like("W52-%")), "week")


@query("region_tally", ids="AG15 AG14", sql=lambda: _tally_sql("", "region"))
def q_region(spark, sf_dir):
    return _tally(WeeklySummary(RetailTables(spark, sf_dir)).summary(), "region")


@query("w53_available_stock", ids="PF14", sql=lambda: W.summary_ctes() + """
SELECT location_code, item_no, week, available_quantity FROM summary
WHERE week_no = 'W53' AND year = 'FY1920' AND available_quantity > 0""")
def q_w53(spark, sf_dir):
    s = WeeklySummary(RetailTables(spark, sf_dir)).summary()
    return (s.where((F.col("week_no") == "W53") & (F.col("year") == "FY1920") & (F.col("available_quantity") > 0))
             .select("location_code", "item_no", "week", "available_quantity"))


@query("top_items_by_billing", ids="SO1 SO2", sql=lambda: SD.pareto_ctes(*ARGS) + """
SELECT brand, item_no, metric_sum FROM mapping ORDER BY metric_sum DESC, brand, item_no LIMIT 10""")
def q_top(spark, sf_dir):
    m = DemandChain(spark, sf_dir).mapping
    return m.select("brand", "item_no", "metric_sum").orderBy(F.desc("metric_sum"), "brand", "item_no").limit(10)


@query("busy_item_stores", ids="AG17", sql=lambda: f"""
SELECT * FROM ({SQ.grid_sql()}) x
WHERE col_pk IN (SELECT col_pk FROM ({SQ.grid_sql()}) y GROUP BY col_pk HAVING count(*) > 2)""")
def q_busy(spark, sf_dir):
    t = RetailTables(spark, sf_dir)
    g = grid.weekly_grid(t.closing_stock_raw, t.sales_raw, t.purchase_raw, t.store_master, t.item_master)
    n = F.count("*").over(Window.partitionBy("col_pk"))
    return g.withColumn("_n", n).where(F.col("_n") > 2).drop("_n")


@query("lumped_item_price", ids="AG27 PF23", sql=lambda: SD.pareto_ctes(*ARGS) + """,
price AS (SELECT p.p_partkey AS item_no, p.p_brand AS brand, cast(p.p_retailprice as decimal(18,2)) AS mrp FROM part p),
mp AS (SELECT pr.*, coalesce(m.lumped, false) AS l FROM price pr LEFT JOIN mapping m
       ON pr.item_no = m.item_no AND pr.brand = m.brand)
SELECT CASE WHEN l THEN 'Others' ELSE cast(item_no as varchar) END AS item_no,
       CASE WHEN l THEN 'Others' ELSE brand END AS brand, """ + mean_sql("mrp").replace(" div ", " // ") + """ AS mrp
FROM mp GROUP BY 1, 2""")
def q_lumped_price(spark, sf_dir):
    """Mean list price per (item, brand) after replaying the item mapping at scoring time."""
    from ..functions.aggregates import mean
    c = DemandChain(spark, sf_dir)
    price = c.t.base("part").select(F.col("p_partkey").alias("item_no"), F.col("p_brand").alias("brand"),
                                    F.col("p_retailprice").cast("decimal(18,2)").alias("mrp"))
    m = c.mapping.select("item_no", "brand", F.col("lumped").alias("_l"))
    j = price.join(m, ["item_no", "brand"], "left")
    lumped = F.coalesce(F.col("_l"), F.lit(False))
    j = j.select(F.when(lumped, F.lit("Others")).otherwise(F.col("item_no").cast("string")).alias("item_no"),
                 F.when(lumped, F.lit("Others")).otherwise(F.col("brand")).alias("brand"), "mrp")
    return j.groupBy("item_no", "brand").agg(mean("mrp").alias("mrp"))


@query("purchase_daily_sql_views", ids="IO6 AG3 SE1",
       sql=lambda: W.fact_ctes() + "\nSELECT * FROM purchase")
def q_views(spark, sf_dir):
    """The same roll-up as text SQL over registered temp views (the source's style)."""
    t = RetailTables(spark, sf_dir)
    t.purchase_raw.createOrReplaceTempView("purchase_raw")
    m = lambda c: mean_sql(c)
    return spark.sql(f"""
SELECT location_code, posting_date, item_no, min(brand) AS brand, min(department) AS department,
       cast(sum(quantity) as bigint) AS quantity, {m('purchase_mrp')} AS purchase_mrp,
       {m('cost_amount')} AS cost_amount, min(state_code) AS state_code, min(region) AS region
FROM purchase_raw WHERE posting_date IS NOT NULL GROUP BY 1, 2, 3""")
