"""DuckDB oracle SQL for the N-week period family."""

from __future__ import annotations

from .sql_weekly import LOWERED, mean, summary_ctes

ITEM_ATTRS = ["case_size", "case_size_range", "gender"] + LOWERED
AVG = ["purchase_cost_amount", "purchase_mrp", "stock_prevailing_mrp", "transfer_cost_amount",
       "days_to_sell", "total_price", "line_discount", "crm_line_discount", "tax", "cost",
       "trade_incentive", "trade_incentive_value"]
STRING_COLS = ["location_code", "week", "brand", "store_in", "product_group_code", "sales_department",
               "store_type", "store_location", "city_type", "state", "region", "week_no", "year",
               "case_size_range", "gender"] + LOWERED
NUMERIC = ["item_no", "quantity", "purchase_quantity", "transfer_quantity", "sales_quantity",
           "purchase_cost_amount", "purchase_mrp", "stock_prevailing_mrp", "transfer_cost_amount",
           "days_to_sell", "num_of_customers", "num_distinct_customers", "total_price",
           "line_discount", "crm_line_discount", "discount", "tax", "cost", "billing", "contribution",
           "trade_incentive", "trade_incentive_value", "total_contribution", "available_quantity",
           "case_size", "area_code"]


def periodic_ctes(n_weeks: int, grain: str = "item") -> str:
    other = ["closing_date", "purchase_date"] + STRING_COLS
    cols = ", ".join([f"coalesce(s.{c}, 0) AS {c}" for c in NUMERIC] + [f"s.{c}" for c in other])
    return summary_ctes(grain) + f""",
kept AS (SELECT * FROM summary s WHERE NOT EXISTS
  (SELECT 1 FROM stores_to_be_removed r WHERE r.location_code = s.location_code)),
period_aggregator AS (
  SELECT year, week_no, week,
         cast(floor((row_number() OVER (ORDER BY year, week_no, week) - 1) / {n_weeks}) + 1 as int) AS period
  FROM (SELECT DISTINCT year, week_no, week FROM kept)),
periodic AS (
  SELECT {cols}, coalesce(p.period, 0) AS period
  FROM kept s LEFT JOIN period_aggregator p ON s.week = p.week AND s.year = p.year AND s.week_no = p.week_no)"""


def rollup_sql(n_weeks: int, keys: list[str], grain: str = "item") -> str:
    return rollup_cte(n_weeks, keys, grain) + "\nSELECT * FROM rolled"


def rollup_cte(n_weeks: int, keys: list[str], grain: str = "item") -> str:
    m = {c: mean(c) for c in AVG}
    opening = "arg_min(quantity, struct_pack(y := year, w := week_no, l := location_code))"
    disc = f"({m['line_discount']} + {m['crm_line_discount']})"
    contr = (f"({m['stock_prevailing_mrp']} - ({m['line_discount']} + {m['crm_line_discount']}"
             f" + {m['tax']} + {m['cost']}))")
    firsts = [c for c in ["location_code", "brand", "store_type", "store_location", "city_type",
                          "region", "state"] if c not in keys]
    sel = [f"min({c}) AS {c}" for c in firsts] + [
        f"{opening} AS quantity",
        "cast(sum(purchase_quantity) as bigint) AS purchase_quantity",
        "cast(sum(transfer_quantity) as bigint) AS transfer_quantity",
        f"cast({opening} + sum(purchase_quantity) + sum(transfer_quantity) as bigint) AS available_quantity",
        "cast(sum(sales_quantity) as bigint) AS sales_quantity",
        f"{m['purchase_cost_amount']} AS purchase_cost_amount",
        f"{m['purchase_mrp']} AS purchase_mrp",
        "min(purchase_date) AS purchase_date",
        f"{m['stock_prevailing_mrp']} AS stock_prevailing_mrp",
        "min(store_in) AS store_in", "min(product_group_code) AS product_group_code",
        f"{m['transfer_cost_amount']} AS transfer_cost_amount",
        "min(sales_department) AS sales_department",
        f"{m['days_to_sell']} AS days_to_sell",
        "cast(sum(num_of_customers) as bigint) AS num_of_customers",
        f"{m['total_price']} AS total_price", f"{m['line_discount']} AS line_discount",
        f"{m['crm_line_discount']} AS crm_line_discount", f"{disc} AS discount",
        f"{m['tax']} AS tax", f"{m['cost']} AS cost",
        f"({m['stock_prevailing_mrp']} - {disc}) AS billing", f"{contr} AS contribution",
        f"{m['trade_incentive']} AS trade_incentive",
        f"{m['trade_incentive_value']} AS trade_incentive_value",
        f"({contr} + {m['trade_incentive_value']}) AS total_contribution",
    ] + [f"min({c}) AS {c}" for c in ITEM_ATTRS] + ["min(area_code) AS area_code"]
    return (periodic_ctes(n_weeks, grain) + f",\nrolled AS (SELECT {', '.join(keys)}, {', '.join(sel)} "
            f"FROM periodic GROUP BY {', '.join(keys)})")


def period_index_sql(n_weeks: int) -> str:
    return periodic_ctes(n_weeks) + "\nSELECT * FROM period_aggregator"


def stores_per_period_sql(n_weeks: int) -> str:
    return periodic_ctes(n_weeks) + """
SELECT state, period, store_type, count(DISTINCT location_code) AS store_count
FROM periodic GROUP BY state, period, store_type"""


def sparsity_sql(n_from: int = 2, n_to: int = 13) -> str:
    return summary_ctes() + f""",
kept AS (SELECT * FROM summary s WHERE NOT EXISTS
  (SELECT 1 FROM stores_to_be_removed r WHERE r.location_code = s.location_code)),
weeks AS (SELECT week, row_number() OVER (ORDER BY year, week_no, week) - 1 AS wi
          FROM (SELECT DISTINCT year, week_no, week FROM kept)),
n AS (SELECT range AS week_agg_no FROM range({n_from}, {n_to + 1})),
sweep_cells AS (
  SELECT n.week_agg_no, cast(floor(w.wi / n.week_agg_no) + 1 as bigint) AS period, k.item_no,
         k.location_code, sum(coalesce(k.sales_quantity, 0)) AS sq
  FROM kept k JOIN weeks w ON k.week = w.week CROSS JOIN n
  GROUP BY 1, 2, 3, 4),
c AS (SELECT week_agg_no, count(*) FILTER (WHERE sq = 0) AS zero_sales,
             count(*) FILTER (WHERE sq > 0) AS pos_sales FROM sweep_cells GROUP BY week_agg_no)
SELECT cast(week_agg_no as int) AS week_agg_no, zero_sales, pos_sales, zero_sales + pos_sales AS total_count,
       cast(zero_sales as double) * 100 / cast(zero_sales + pos_sales as double) AS zero_percent,
       cast(pos_sales as double) * 100 / cast(zero_sales + pos_sales as double) AS pos_percent
FROM c"""
