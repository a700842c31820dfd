"""Weekly summary family: facts, weekly roll-ups, four-fact merge, dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts
from ..operators import weekly as wk
from ..operators.codes import rolled
from ..sources.testdata import RetailTables
from . import sql_weekly as S
from .catalog import query


def _tables(spark, sf_dir, grain="item"):
    return RetailTables(spark, sf_dir, grain)


@query("sales_weekly", ids="PF1 PF2 PF3 AG2 AG6 SC1",
       sql=lambda: S.fact_ctes() + "\nSELECT * FROM sales_weekly")
def q_sales_weekly(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return rolled(t.sales_raw, lambda raw: wk.sales_weekly(facts.sales_daily(raw)))


@query("closing_stock_weekly", ids="AG1 SC2",
       sql=lambda: S.fact_ctes() + "\nSELECT * FROM closing_stock")
def q_closing_stock(spark, sf_dir):
    return rolled(_tables(spark, sf_dir).closing_stock_raw, facts.closing_stock)


@query("purchase_weekly", ids="AG3 AG4",
       sql=lambda: S.fact_ctes() + "\nSELECT * FROM purchase_weekly")
def q_purchase_weekly(spark, sf_dir):
    return rolled(_tables(spark, sf_dir).purchase_raw, lambda raw: wk.purchase_weekly(facts.purchase_daily(raw)))


@query("transfer_weekly", ids="AG5",
       sql=lambda: S.fact_ctes() + "\nSELECT * FROM transfer_weekly")
def q_transfer_weekly(spark, sf_dir):
    return rolled(_tables(spark, sf_dir).transfer_raw, lambda raw: wk.transfer_weekly(facts.transfers(raw)))


@query("weekly_cells", ids="J1 J2 J3 PF4 AG11",
       sql=lambda: S.cells_ctes() + "\nSELECT * FROM cells")
def q_weekly_cells(spark, sf_dir):
    return wk.WeeklySummary(_tables(spark, sf_dir)).cells()


@query("weekly_summary", ids="J7 J8 J9 PF5 PF9 PF10 PF15 SC4 SC8 SE5 U4",
       sql=lambda: S.summary_ctes() + "\nSELECT * FROM summary")
def q_weekly_summary(spark, sf_dir):
    return wk.WeeklySummary(_tables(spark, sf_dir)).summary()
