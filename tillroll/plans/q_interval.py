"""Interval (N-week window) summary family."""

from __future__ import annotations

from ..operators import facts
from ..operators import interval as I
from ..operators.codes import CodedFacts
from ..sources.testdata import RetailTables
from . import sql_interval as S
from . import sql_weekly as W
from .catalog import query

WINDOW_WEEKS = 6


def _inputs(spark, sf_dir, n):
    t = RetailTables(spark, sf_dir)
    raw = CodedFacts(t)
    stock = facts.closing_stock(raw.closing_stock_raw)
    kept = I.kept_closing_dates(stock, n)
    return (t, raw.codes, stock, facts.purchase_daily(raw.purchase_raw), facts.transfers(raw.transfer_raw),
            facts.sales_daily(raw.sales_raw, 0, None), kept)


@query("kept_closing_dates", ids="W1",
       sql=lambda: W.fact_ctes() + f"""
SELECT closing_date, period_number FROM (
  SELECT closing_date, cast(row_number() OVER (ORDER BY closing_date) as int) AS period_number
  FROM (SELECT DISTINCT closing_date FROM closing_stock))
WHERE period_number % {WINDOW_WEEKS} = 1 % {WINDOW_WEEKS}""")
def q_kept(spark, sf_dir):
    return _inputs(spark, sf_dir, WINDOW_WEEKS)[-1]


@query("interval_summary", ids="J4 J5 J6 PF3 AG11 J18",
       sql=lambda: S.interval_ctes(WINDOW_WEEKS) + "\nSELECT * FROM interval_summary")
def q_interval(spark, sf_dir):
    t, codes, stock, p, tr, s, kept = _inputs(spark, sf_dir, WINDOW_WEEKS)
    cells = codes.decode(I.interval_cells(stock, p, tr, s, kept, WINDOW_WEEKS))
    return I.interval_summary(cells, kept, t.store_master, t.item_master, t.area_codes)
