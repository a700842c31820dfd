"""Item-master cleaning, encodings, splits, calendars and QA checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fiscal import fiscal_parts, week_label
from ..operators import facts
from ..operators import features as FE
from ..operators import quality as Q
from ..operators.selection import row_hash, row_hash_sql
from ..sources import files as IO
from ..sources.testdata import RetailTables, oracle_ctes
from . import sql_demand as SD
from . import sql_quality as SQ
from . import sql_weekly as W
from .catalog import query
from .q_demand import ARGS, PERIOD_WEEKS, DemandChain

IMPUTE = ["strap_color", "case_size_range", "glass", "dial_color", "strap_type", "case_shape", "material",
          "case_size", "movement"]

@query("item_master_cleaned", ids="PF8 PF7 PF21 DQ3", sql=lambda: oracle_ctes("sku") + """
SELECT item_no, case_size, nullif(case_size_range, '') AS case_size_range,
       CASE WHEN case_size > 38 THEN 'Men' WHEN gender IS NULL OR gender = '' THEN 'Women' ELSE gender END AS gender,
       nullif(movement, '') AS movement, nullif(material, '') AS material, nullif(dial_color, '') AS dial_color,
       nullif(strap_type, '') AS strap_type, nullif(strap_color, '') AS strap_color,
       coalesce(precious_stone, 'no') AS precious_stone, nullif(glass, '') AS glass,
       nullif(case_shape, '') AS case_shape, watch_type
FROM item_master""")
def q_item_clean(spark, sf_dir):
    im = RetailTables(spark, sf_dir, "sku").item_master
    return Q.gender_rule(Q.blank_to_null(im, IMPUTE)).fillna({"precious_stone": "no"})


@query("one_hot_levels", ids="FE4", sql=lambda: SD.pareto_ctes(*ARGS) + ",\nlv AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, coalesce(nullif(cast({c} as varchar), ''), 'nan') AS level FROM target_b"
    for c in FE.CAT_COLS) + """)
SELECT feature, level, cast(dense_rank() OVER (PARTITION BY feature ORDER BY level) - 1 as double) AS level_index,
       count(*) OVER (PARTITION BY feature, level) AS rows
FROM (SELECT DISTINCT * FROM lv) d JOIN (SELECT feature AS f2, level AS l2 FROM lv) a
  ON d.feature = a.f2 AND d.level = a.l2 GROUP BY feature, level""".replace(
    "count(*) OVER (PARTITION BY feature, level) AS rows", "count(*) AS rows"))
def q_one_hot(spark, sf_dir):
    """Fitted StringIndexer (alphabetical) index and row count per level."""
    df = FE.prepare(DemandChain(spark, sf_dir).target("B"), FE.CAT_COLS, [])
    model = FE.one_hot_pipeline(FE.CAT_COLS, []).fit(df)
    idx = model.stages[0].transform(df)
    parts = [idx.select(F.lit(c).alias("feature"), F.col(c).alias("level"), F.col(f"{c}__idx").alias("level_index"))
             for c in FE.CAT_COLS]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("feature", "level", "level_index").agg(F.count("*").alias("rows"))


@query("unique_skus", ids="FE9", sql=lambda: SD.pareto_ctes(*ARGS) + f"""
SELECT DISTINCT {', '.join(FE.SKU_COLS)} FROM rk""")
def q_unique_skus(spark, sf_dir):
    return FE.unique_sku_rows(DemandChain(spark, sf_dir).kept)


@query("null_impact_report_file", ids="AG25 IO9 IO7", sql=SQ.null_impact_sql)
def q_report_file(spark, sf_dir):
    """The null-impact report written as one CSV file and read back."""
    from .q_quality import _imputation_input
    rep = Q.null_impact_report(_imputation_input(spark, sf_dir))
    path = IO.shared_scratch(spark, "null-report")
    IO.write_single_csv(rep, path)
    return spark.read.schema(rep.schema).option("header", True).csv(path)


@query("stocked_items_with_sales", ids="J15 SE4", sql=lambda: W.fact_ctes() + """
SELECT * FROM closing_stock c WHERE EXISTS
  (SELECT 1 FROM sales s WHERE s.location_code = c.location_code AND s.item_no = c.item_no)""")
def q_semi(spark, sf_dir):
    t = RetailTables(spark, sf_dir)
    stock = facts.closing_stock(t.closing_stock_raw)
    keys = facts.sales_daily(t.sales_raw).select("location_code", "item_no").distinct()
    return stock.join(keys, ["location_code", "item_no"], "left_semi")


# fixed values: the closing dates the stock-vs-sales check looks at
QA_CLOSING_DATES = ["2018-07-29", "2019-09-08"]


@query("sales_after_stock_window", ids="J17 PF11", sql=lambda: W.fact_ctes("item", 0, 2) + f"""
SELECT c.location_code, c.item_no, c.closing_date, s.sales_date, s.customer_no, s.quantity
FROM closing_stock c JOIN sales s ON c.location_code = s.location_code AND c.item_no = s.item_no
WHERE c.closing_date IN ({", ".join(f"DATE '{d}'" for d in QA_CLOSING_DATES)})
  AND c.closing_date <= s.sales_date AND s.sales_date > c.closing_date + 7""")
def q_after(spark, sf_dir):
    """Sales of a stocked (store, item) dated after the week that follows the
    given closing dates: an equi-join on (store, item) plus a date filter; the
    fan-out per key is bounded by the number of closing dates checked."""
    import datetime as dt
    t = RetailTables(spark, sf_dir)
    stock = facts.closing_stock(t.closing_stock_raw).where(
        F.col("closing_date").isin([dt.date.fromisoformat(d) for d in QA_CLOSING_DATES]))
    sales = facts.sales_daily(t.sales_raw)
    j = stock.select("location_code", "item_no", "closing_date").join(
        sales.select("location_code", "item_no", "sales_date", "customer_no", "quantity"), ["location_code", "item_no"])
    return j.where((F.col("closing_date") <= F.col("sales_date"))
                   & (F.col("sales_date") > F.date_add("closing_date", 7)))


@query("fiscal_calendar", ids="SC3 SC1 SC7", sql=lambda: W.fact_ctes() + """
SELECT DISTINCT sales_date, """ + W.sql_week_label("sales_date") + """ AS week,
       cast(month(sales_date - 91) as int) AS fiscal_month, cast(weekofyear(sales_date - 91) as int) AS fiscal_week,
       cast(year(sales_date - 91) % 100 as int) AS fiscal_year, cast(month(sales_date) as int) AS month,
       cast(year(sales_date) as int) AS year
FROM sales_raw WHERE sales_date IS NOT NULL""")
def q_calendar(spark, sf_dir):
    d = RetailTables(spark, sf_dir).sales_raw.where(F.col("sales_date").isNotNull()).select("sales_date").distinct()
    parts = fiscal_parts("sales_date")
    return d.select("sales_date", week_label("sales_date").alias("week"),
                    *[v.cast("int").alias(k) for k, v in parts.items()],
                    F.month("sales_date").alias("month"), F.year("sales_date").alias("year"))


_SPLIT_KEYS = ["store_type", "item_no", "period", "state"]


@query("ordered_split_counts", ids="SO3 SE2", sql=lambda: SD.pareto_ctes(*ARGS) + f""",
hashed AS (SELECT *, {row_hash_sql(42, _SPLIT_KEYS)} AS h FROM target_b),
placed AS (SELECT *, row_number() OVER (ORDER BY period NULLS FIRST, h) AS place, count(*) OVER () AS n FROM hashed)
SELECT place <= n - cast(floor(n * 0.2) as bigint) AS is_train, period, count(*) AS rows, cast(sum(h % 1000003) as bigint) AS key_sum
FROM placed GROUP BY 1, 2""")
def q_ordered(spark, sf_dir):
    """Rows of either side by period, and a sum over their keys that tells them from others."""
    df = FE.ordered_split(DemandChain(spark, sf_dir).target("B"), _SPLIT_KEYS, 0.2)
    return df.withColumn("h", row_hash(42, _SPLIT_KEYS) % 1000003).groupBy("is_train", "period").agg(
        F.count("*").alias("rows"), F.sum("h").alias("key_sum"))


@query("complete_period_demand", ids="PF22 J18", sql=lambda: SD.pareto_ctes(*ARGS) + f""",
pw AS (SELECT period, count(*) AS w FROM period_aggregator GROUP BY period),
bad AS (SELECT period FROM pw WHERE period = (SELECT max(period) FROM pw) AND w < {PERIOD_WEEKS})
SELECT * EXCLUDE (r) FROM target_b WHERE period NOT IN (SELECT period FROM bad)""")
def q_complete(spark, sf_dir):
    c = DemandChain(spark, sf_dir)
    return FE.drop_incomplete_last_period(c.target("B"), c.periods, PERIOD_WEEKS)
