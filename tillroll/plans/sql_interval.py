"""DuckDB oracle SQL for the interval summary: every fact is dealt to its windows and summed on its own,
and the sums are looked up from one list of keys."""

from __future__ import annotations

from .sql_weekly import LOWERED, SALES_OUT, fact_ctes, mean

KEY = ("location_code", "item_no", "closing_date")


def _dealt(name: str, fact: str, store: str, day: str, span: int, sums: str) -> str:
    """Sums of a fact per stocked window it lies in; facts in no stocked window share the null window."""
    return f"""
{name} AS (
  SELECT f.{store} AS location_code, f.item_no, w.closing_date, count(*) AS lines, {sums}
  FROM {fact} f LEFT JOIN stocked w
    ON w.location_code = f.{store} AND w.item_no = f.item_no
   AND f.{day} BETWEEN w.closing_date + 1 AND w.closing_date + {span}
  GROUP BY f.{store}, f.item_no, w.closing_date)"""


def interval_ctes(n_weeks: int) -> str:
    span = 7 * n_weeks
    same = lambda t: " AND ".join(f"{t}.{k} IS NOT DISTINCT FROM key.{k}" for k in KEY)
    bought = _dealt("bought", "purchase", "location_code", "posting_date", span,
                    f"sum(f.quantity) AS quantity, min(f.posting_date) AS first_day, min(f.brand) AS brand, "
                    f"{mean('f.purchase_mrp')} AS mrp")
    moved = _dealt("moved", "transfer", "store_in", "store_in_date", span,
                   f"sum(f.quantity) AS quantity, min(f.store_in_date) AS first_day, min(f.brand) AS brand, "
                   f"min(f.product_group_code) AS product_group_code, {mean('f.mrp')} AS mrp, "
                   f"{mean('f.cost_amount')} AS cost_amount")
    sold = _dealt("sold", "sales", "location_code", "sales_date", span,
                  f"cast(sum(f.quantity) as bigint) AS quantity, min(f.brand) AS brand, {mean('f.price')} AS mrp, "
                  + ", ".join(f"{mean('f.' + c)} AS {c}" for c in SALES_OUT))
    zero = lambda x: f"coalesce({x}, 0)"
    return fact_ctes("item", 0, None) + f""",
calendar AS (SELECT closing_date, cast(dense_rank() OVER (ORDER BY closing_date) as int) AS period_number
             FROM (SELECT DISTINCT closing_date FROM closing_stock)),
kept_dates AS (SELECT closing_date, period_number FROM calendar WHERE period_number % {n_weeks} = 1 % {n_weeks}),
stocked AS (SELECT s.* FROM closing_stock s SEMI JOIN kept_dates k ON k.closing_date = s.closing_date),{bought},{moved},{sold},
key AS (
  SELECT location_code, item_no, closing_date FROM stocked
  UNION SELECT location_code, item_no, closing_date FROM bought
  UNION SELECT location_code, item_no, closing_date FROM moved
  UNION SELECT location_code, item_no, closing_date FROM sold),
interval_summary AS (
  SELECT key.location_code, {zero('key.item_no')} AS item_no, key.closing_date,
         st.purchase_date, b.first_day AS posting_date, m.first_day AS store_in_date,
         coalesce(st.brand, b.brand, m.brand, x.brand) AS brand, m.product_group_code,
         {zero('coalesce(st.stock_prevailing_mrp, b.mrp, m.mrp, x.mrp)')} AS stock_prevailing_mrp,
         cast({zero('st.quantity')} as double) AS quantity, cast({zero('b.quantity')} as double) AS purchase_quantity,
         cast({zero('m.quantity')} as double) AS transfer_quantity, {zero('x.quantity')} AS sales_quantity,
         {zero('st.cost_amount')} AS cost_amount, {zero('st.purchase_mrp')} AS purchase_mrp,
         {zero('m.cost_amount')} AS transfer_cost_amount,
         {zero("cast(datediff('day', st.purchase_date, key.closing_date) as int)")} AS days_to_sell,
         {", ".join(f"{zero('x.' + c)} AS {c}" for c in SALES_OUT)},
         cast({zero('st.quantity')} + {zero('b.quantity')} + {zero('m.quantity')} as double) AS available_quantity,
         d.store_type, d.store_location, d.city_type, d.state, d.region,
         i.case_size, i.case_size_range, i.gender, {", ".join(f"lower(i.{c}) AS {c}" for c in LOWERED)},
         ac.area_code, k.period_number
  FROM key LEFT JOIN stocked st ON {same('st')} LEFT JOIN bought b ON {same('b')}
  LEFT JOIN moved m ON {same('m')} LEFT JOIN sold x ON {same('x')}
  LEFT JOIN kept_dates k ON k.closing_date = key.closing_date
  LEFT JOIN store_master d ON d.store_code = key.location_code
  LEFT JOIN item_master i ON i.item_no = key.item_no
  LEFT JOIN area_codes ac ON ac.state_code = d.state)"""
