"""DuckDB oracle SQL for the grid, returns and data-quality family."""

from __future__ import annotations

from ..sources.testdata import oracle_ctes
from ..functions.fiscal import FLOW_OVERRIDES, FLOW_SHIFT, sql_week_label
from .sql_weekly import mean, summary_ctes

ATTRS = ["case_size", "case_size_range", "gender", "movement", "material", "dial_color", "strap_type",
         "strap_color", "precious_stone", "glass", "case_shape", "watch_type"]


def grid_sql() -> str:
    return oracle_ctes("item") + f""",
stock AS (SELECT * FROM closing_stock_raw WHERE closing_date IS NOT NULL),
weeks AS (SELECT DISTINCT closing_date AS week FROM stock),
corp AS (SELECT location_code, sales_date, item_no, customer_no,
                CASE WHEN sum(raw_quantity) > 2 THEN 1 ELSE 0 END AS corporate_order
         FROM sales_raw GROUP BY 1, 2, 3, 4),
st AS (SELECT location_code, item_no, closing_date AS week, sum(quantity) AS stock_quantity,
              {mean('purchase_mrp')} AS purchase_mrp, {mean('stock_prevailing_mrp')} AS stock_prevailing_mrp,
              min(state) AS state, min(region) AS region,
              {mean("datediff('day', purchase_date, closing_date)")} AS days_in_stock_agg
       FROM stock GROUP BY 1, 2, 3),
sw AS (SELECT s.location_code, s.item_no, w.week, sum(s.quantity) AS sales_quantity,
              {mean("datediff('day', s.receipt_date, s.sales_date)")} AS days_to_sell,
              {mean('s.billing')} AS avg_billing
       FROM sales_raw s JOIN weeks w ON s.sales_date > w.week AND s.sales_date <= w.week + 7
       GROUP BY 1, 2, 3),
cw AS (SELECT c.location_code, c.item_no, w.week, max(c.corporate_order) AS corporate_order
       FROM corp c JOIN weeks w ON c.sales_date > w.week AND c.sales_date <= w.week + 7 GROUP BY 1, 2, 3),
pw AS (SELECT p.location_code, p.item_no, w.week, sum(p.quantity) AS purchase_quantity
       FROM purchase_raw p JOIN weeks w ON p.posting_date > w.week AND p.posting_date <= w.week + 7
       GROUP BY 1, 2, 3),
grid AS (SELECT location_code, item_no, week FROM st UNION SELECT location_code, item_no, week FROM sw)
SELECT concat_ws('_', cast(g.item_no as varchar), g.location_code) AS col_pk, g.item_no, g.location_code,
       g.week, cast(month(g.week) as int) AS month, cast(year(g.week) as int) AS year,
       cast(coalesce(st.stock_quantity, 0) as bigint) AS stock_quantity, st.purchase_mrp,
       st.stock_prevailing_mrp, st.state, st.region, st.days_in_stock_agg,
       coalesce(cw.corporate_order, 0) AS corporate_order,
       cast(coalesce(sw.sales_quantity, 0) as bigint) AS sales_quantity,
       coalesce(sw.days_to_sell, 0.0) AS days_to_sell, coalesce(sw.avg_billing, 0.0) AS avg_billing,
       cast(coalesce(pw.purchase_quantity, 0) as bigint) AS purchase_quantity,
       cast(coalesce(st.stock_quantity, 0) + coalesce(pw.purchase_quantity, 0) as bigint) AS total_available_qty,
       sm.store_type, sm.store_location, sm.city_type, i.case_size, i.case_size_range, i.gender, i.movement,
       i.material, i.dial_color, i.strap_type, i.strap_color, i.precious_stone, i.glass, i.case_shape,
       i.watch_type
FROM grid g
LEFT JOIN st ON st.location_code = g.location_code AND st.item_no = g.item_no AND st.week = g.week
LEFT JOIN sw ON sw.location_code = g.location_code AND sw.item_no = g.item_no AND sw.week = g.week
LEFT JOIN cw ON cw.location_code = g.location_code AND cw.item_no = g.item_no AND cw.week = g.week
LEFT JOIN pw ON pw.location_code = g.location_code AND pw.item_no = g.item_no AND pw.week = g.week
JOIN store_master sm ON sm.store_code = g.location_code
JOIN item_master i ON i.item_no = g.item_no"""


def bulk_orders_sql() -> str:
    return oracle_ctes("item") + """
SELECT location_code, sales_date, item_no, customer_no, cast(sum(raw_quantity) as bigint) AS customer_day_quantity,
       CASE WHEN sum(raw_quantity) > 2 THEN 1 ELSE 0 END AS corporate_order
FROM sales_raw GROUP BY 1, 2, 3, 4"""


def _weekly_signed() -> str:
    return oracle_ctes("item") + """,
weekly AS (
  SELECT item_no, location_code, cast(date_trunc('week', sales_date) as date) AS week_start,
         cast(sum(quantity) as bigint) AS sales_qty_in_week,
         concat_ws('_', cast(item_no as varchar), location_code) AS col_pk
  FROM sales_raw GROUP BY 1, 2, 3)"""


def returns_sql() -> str:
    return _weekly_signed() + """
SELECT n.col_pk, n.item_no, n.location_code, n.week_start, n.week_start - 7 AS prev_week_start,
       n.sales_qty_in_week AS returned_quantity, p.sales_qty_in_week AS sold_quantity_prev_week
FROM weekly n JOIN weekly p ON n.col_pk = p.col_pk AND p.week_start = n.week_start - 7
WHERE n.sales_qty_in_week < 0 AND p.sales_qty_in_week > 0"""


def sign_buckets_sql() -> str:
    return _weekly_signed() + """
SELECT CASE WHEN sales_qty_in_week > 0 THEN 'positive' WHEN sales_qty_in_week < 0 THEN 'negative'
            ELSE 'zero' END AS bucket, count(*) AS weeks
FROM weekly GROUP BY 1"""


def imputation_input_ctes() -> str:
    attrs = ", ".join(f"i.{a}" if a != "precious_stone" else "coalesce(i.precious_stone, 'no') AS precious_stone"
                      for a in ATTRS)
    cols = ["item_no"] + ATTRS + ["mrp", "sales_quantity"]
    nulls = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in cols)
    return summary_ctes("sku") + f""",
totals AS (SELECT item_no, cast(sum(cast(stock_prevailing_mrp as decimal(38,8))) as double) AS mrp,
                  cast(sum(sales_quantity) as bigint) AS sales_quantity FROM summary GROUP BY item_no),
imf0 AS (SELECT t.item_no, {attrs}, t.mrp, t.sales_quantity
         FROM item_master i RIGHT JOIN totals t ON i.item_no = t.item_no),
imf AS (SELECT *, {nulls} AS null_cnt FROM imf0)"""


def null_impact_sql() -> str:
    allc = ["item_no"] + ATTRS + ["mrp", "sales_quantity", "null_cnt"]
    any_null = " OR ".join(f"{c} IS NULL" for c in allc)
    md = "cast(mrp as decimal(38,8))"
    parts = []
    for c in ATTRS + ["__ALL__"]:
        cond = f"({any_null})" if c == "__ALL__" else f"{c} IS NULL"
        name = "All Nulls" if c == "__ALL__" else c
        parts.append(f"SELECT '{name}' AS feature, count(*) FILTER (WHERE {cond}) AS row_count, "
                     f"sum({md}) FILTER (WHERE {cond}) AS mrp, sum(sales_quantity) FILTER (WHERE {cond}) AS sq, "
                     f"sum(null_cnt) FILTER (WHERE {cond}) AS nc FROM imf")
    parts.append(f"SELECT 'Total', count(*), sum({md}), sum(sales_quantity), sum(null_cnt) FROM imf")
    return imputation_input_ctes() + f""",
rows_ AS ({' UNION ALL '.join(parts)}),
tot AS (SELECT count(*) AS t_rows, sum({md}) AS t_mrp, sum(sales_quantity) AS t_sq, sum(null_cnt) AS t_nc FROM imf)
SELECT feature, row_count, cast(r.mrp as double) AS mrp, cast(sq as bigint) AS sales_quantity,
       cast(nc as bigint) AS null_cnt,
       cast(row_count as double) * 100 / cast(t_rows as double) AS row_pct,
       cast(r.mrp as double) * 100 / cast(t_mrp as double) AS mrp_pct,
       cast(cast(sq as bigint) as double) * 100 / cast(t_sq as double) AS sales_qty_pct,
       cast(cast(nc as bigint) as double) * 100 / cast(t_nc as double) AS null_count_pct
FROM rows_ r, tot WHERE row_count > 0"""


def null_audit_sql() -> str:
    return summary_ctes("item") + """,
u AS (SELECT * FROM (SELECT COLUMNS(*)::VARCHAR FROM summary)
      UNPIVOT INCLUDE NULLS (v FOR column_name IN (COLUMNS(*))))
SELECT column_name, count(*) FILTER (WHERE v IS NULL) AS null_count FROM u GROUP BY column_name"""


def conservation_sql() -> str:
    pairs = [("quantity", "closing_stock", "quantity"), ("purchase_quantity", "purchase_weekly", "quantity"),
             ("transfer_quantity", "transfer_weekly", "quantity"), ("sales_quantity", "sales_weekly", "quantity")]
    sel = " UNION ALL ".join(
        f"SELECT '{m}' AS measure, cast((SELECT sum({c}) FROM {t}) as double) AS before, "
        f"cast((SELECT sum({m}) FROM summary) as double) AS after" for m, t, c in pairs)
    return summary_ctes("item") + f"""
SELECT measure, before, after, coalesce(before, 0) = coalesce(after, 0) AS conserved FROM ({sel})"""


def unmapped_stores_sql() -> str:
    return oracle_ctes("item") + """,
seen AS (SELECT location_code AS code FROM closing_stock_raw UNION ALL SELECT location_code FROM purchase_raw
         UNION ALL SELECT store_in FROM transfer_raw UNION ALL SELECT location_code FROM sales_raw)
SELECT code AS key, count(*) AS fact_rows FROM seen
WHERE code NOT IN (SELECT store_code FROM store_master
                   WHERE store_code NOT IN (SELECT location_code FROM stores_to_be_removed))
GROUP BY code"""


def sales_without_summary_sql() -> str:
    week = sql_week_label("sales_date", FLOW_SHIFT, FLOW_OVERRIDES)
    return summary_ctes("item") + f"""
SELECT location_code, item_no, week, count(*) AS fact_rows, cast(sum(quantity) as bigint) AS quantity
FROM (SELECT *, {week} AS week FROM sales_raw WHERE sales_date IS NOT NULL) r
WHERE NOT EXISTS (SELECT 1 FROM summary s WHERE s.location_code = r.location_code AND s.item_no = r.item_no AND s.week = r.week)
GROUP BY location_code, item_no, week"""


def stock_sales_key_sets_sql() -> str:
    return oracle_ctes("sku") + """,
k AS (SELECT location_code, item_no, max(a) AS a, max(b) AS b FROM (
        SELECT location_code, item_no, 1 AS a, 0 AS b FROM closing_stock_raw
        UNION ALL SELECT location_code, item_no, 0, 1 FROM sales_raw) GROUP BY 1, 2)
SELECT CASE WHEN a + b = 2 THEN 'both' WHEN a = 1 THEN 'first_only' ELSE 'second_only' END AS side, count(*) AS keys
FROM k GROUP BY 1"""


def key_uniqueness_sql() -> str:
    return oracle_ctes("sku") + """
SELECT count(*) AS row_count, count(DISTINCT item_no) AS distinct_keys FROM item_master"""


def never_sold_sql() -> str:
    return summary_ctes("sku") + """
SELECT item_no FROM summary GROUP BY item_no HAVING sum(sales_quantity) = 0"""


def level_frequency_sql() -> str:
    return summary_ctes("item") + """,
g AS (SELECT store_type AS level, count(*) AS n, sum(cast(billing as decimal(38,8))) AS w
      FROM summary GROUP BY store_type)
SELECT level, n, cast(n as double) * 100 / cast((SELECT sum(n) FROM g) as double) AS pct,
       cast(w as double) AS billing_sum,
       cast(w as double) * 100 / cast((SELECT sum(w) FROM g) as double) AS weight_pct
FROM g"""


def modes_sql() -> str:
    parts = []
    for a in ATTRS:
        parts.append(f"""SELECT '{a}' AS attribute, (SELECT cast({a} as varchar) FROM item_master
          WHERE {a} IS NOT NULL GROUP BY {a} ORDER BY count(*) DESC, {a} ASC LIMIT 1) AS mode_value""")
    return oracle_ctes("sku") + "\n" + " UNION ALL ".join(parts)


def fuzzy_sql(attrs: list[str], threshold: float, top: int) -> str:
    parts = " UNION ALL ".join(f"SELECT DISTINCT '{a}' AS feature, lower({a}) AS level FROM item_master "
                               f"WHERE {a} IS NOT NULL" for a in attrs)
    return oracle_ctes("sku") + f""",
lv AS ({parts}),
pairs AS (
  SELECT a.feature, a.level, b.level AS match,
         1.0 - cast(levenshtein(a.level, b.level) as double) / greatest(length(a.level), length(b.level)) AS similarity
  FROM lv a JOIN lv b ON a.feature = b.feature AND a.level <> b.level),
ranked AS (SELECT *, row_number() OVER (PARTITION BY feature, level ORDER BY similarity DESC, match) AS rk
           FROM pairs WHERE similarity >= {threshold})
SELECT feature, level, match, similarity, cast(rk as int) AS match_rank FROM ranked WHERE rk <= {top}"""
