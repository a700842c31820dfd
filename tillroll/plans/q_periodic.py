"""N-week period family."""

from __future__ import annotations

from ..operators import periodic as P
from ..operators.weekly import WeeklySummary, written_summary
from ..sources.testdata import RetailTables
from . import sql_periodic as S
from .catalog import query

PERIOD_WEEKS = 12


def _written(spark, sf_dir):
    return written_summary(RetailTables(spark, sf_dir))


def _periodic(spark, sf_dir, n=PERIOD_WEEKS):
    t = RetailTables(spark, sf_dir)
    return P.with_periods(written_summary(t), n, t.stores_to_be_removed)


@query("period_index", ids="W2 SO1", sql=lambda: S.period_index_sql(PERIOD_WEEKS))
def q_period_index(spark, sf_dir):
    t = RetailTables(spark, sf_dir)
    s = WeeklySummary(t).summary().join(t.stores_to_be_removed, "location_code", "left_anti")
    return P.period_index(s, PERIOD_WEEKS)


@query("period_rollup_store", ids="J13 J18 PF5 AG7 AG9",
       sql=lambda: S.rollup_sql(PERIOD_WEEKS, ["period", "item_no", "location_code"]))
def q_rollup_store(spark, sf_dir):
    return P.rollup_by_store(_periodic(spark, sf_dir), _written(spark, sf_dir))


@query("period_rollup_store_type", ids="AG8 AG9",
       sql=lambda: S.rollup_sql(PERIOD_WEEKS, ["period", "item_no", "state", "store_type"]))
def q_rollup_store_type(spark, sf_dir):
    return P.rollup_by_store_type(_periodic(spark, sf_dir), _written(spark, sf_dir))


@query("stores_per_period", ids="AG16 SE4", sql=lambda: S.stores_per_period_sql(PERIOD_WEEKS))
def q_stores_per_period(spark, sf_dir):
    return P.stores_per_period(_periodic(spark, sf_dir))


@query("sparsity_sweep", ids="AG26", sql=lambda: S.sparsity_sql(2, 13))
def q_sparsity(spark, sf_dir):
    t = RetailTables(spark, sf_dir)
    return P.sparsity_sweep(written_summary(t), 2, 13, t.stores_to_be_removed)
