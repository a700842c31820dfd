"""Pareto lumping, demand frame, market size and log-share target."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pareto as PA
from ..operators import periodic as P
from ..operators import quality as Q
from ..operators import share as SH
from ..operators.weekly import coded_summary
from ..session import app_key, materialize
from ..sources.testdata import RetailTables
from . import sql_demand as S
from .catalog import query

PERIOD_WEEKS = 12
ITEM_SHARE = 0.05
# fixture setting: 62-96 SKUs per brand at sf0.01, so lumping needs a bound below 100
ITEM_MIN_LEVELS = 50
FEATURE_SHARE = 0.10
FEATURE_MIN_LEVELS = 10


_CHAINS: dict = {}


class DemandChain:
    """Period roll-up by store type at SKU grain → never-sold removal → item
    Pareto → regroup → market size → log share → feature Pareto."""

    def __new__(cls, spark, sf_dir):
        # one chain per session and input folder: its tables are materialised once
        key = (app_key(spark), sf_dir)
        if key not in _CHAINS:
            _CHAINS.clear()
            obj = super().__new__(cls)
            obj._build(spark, sf_dir)
            _CHAINS[key] = obj
        return _CHAINS[key]

    def __init__(self, spark, sf_dir):
        pass

    def _build(self, spark, sf_dir):
        t = RetailTables(spark, sf_dir, "sku")
        self.t = t
        self.summary, codes = coded_summary(t)
        gone = codes.encode(t.stores_to_be_removed)
        self.periods = P.period_index(self.summary.join(gone, "location_code", "left_anti"), PERIOD_WEEKS)
        rolled = P.rollup_by_store_type(P.with_periods(self.summary, PERIOD_WEEKS, t.stores_to_be_removed, codes), codes=codes)
        # the one wide table that is written: all that follows is read off it without a shuffle of its rows
        self.kept = materialize(Q.drop_never_sold(rolled), "demand-kept", buckets=(t.parts, "item_no"))
        self.mapping = materialize(PA.item_pareto_mapping(self.kept, ITEM_SHARE, ITEM_MIN_LEVELS), "item-mapping")
        self.lumped = PA.apply_item_pareto(self.kept, self.mapping, "Others", True, PA.ITEM_COLS, parts=t.parts)
        # the kept rows are unique by these keys, so those that are not lumped stay what they are
        self.demand = SH.regroup_lumped(self.lumped.drop("_orig_brand"), alone=~F.col("_lumped"))
        self.sizes = materialize(SH.market_sizes(self.demand, t.market_share, "store_type"), "market-sizes")

    def target(self, variant="B"):
        return SH.log_share(self.demand, self.sizes, variant)

    def feature_mapping(self):
        return PA.feature_pareto_mapping(self.target("B"), PA.ITEM_COLS, FEATURE_SHARE, FEATURE_MIN_LEVELS)


ARGS = (PERIOD_WEEKS, ITEM_SHARE, ITEM_MIN_LEVELS)


@query("item_pareto_mapping", ids="W3", sql=lambda: S.pareto_ctes(*ARGS) + "\nSELECT * FROM mapping")
def q_item_map(spark, sf_dir):
    return DemandChain(spark, sf_dir).mapping


@query("item_pareto_report", ids="W3 W5 AG21", sql=lambda: S.item_pareto_report_sql(*ARGS))
def q_item_report(spark, sf_dir):
    c = DemandChain(spark, sf_dir)
    return PA.item_pareto_report(c.lumped, c.mapping)


@query("demand_frame", ids="AG18 AG19 PF19 PF23 SO1", sql=lambda: S.pareto_ctes(*ARGS) + "\nSELECT * FROM demand")
def q_demand(spark, sf_dir):
    return DemandChain(spark, sf_dir).demand


@query("market_size", ids="FE1 AG20 J19", sql=lambda: S.pareto_ctes(*ARGS) + "\nSELECT * FROM sizes")
def q_sizes(spark, sf_dir):
    return DemandChain(spark, sf_dir).sizes


@query("log_share_b", ids="FE3 SC10 SC11 PF20",
       sql=lambda: S.pareto_ctes(*ARGS) + "\nSELECT * EXCLUDE (r) FROM target_b")
def q_log_b(spark, sf_dir):
    return DemandChain(spark, sf_dir).target("B")


@query("log_share_a", ids="FE2", sql=lambda: S.pareto_ctes(*ARGS) + "\nSELECT * EXCLUDE (r) FROM target_a")
def q_log_a(spark, sf_dir):
    return DemandChain(spark, sf_dir).target("A")


FARGS = ARGS + (FEATURE_SHARE, FEATURE_MIN_LEVELS)


@query("feature_pareto_mapping", ids="W4 U3", sql=lambda: S.feature_ctes(*FARGS) + "\nSELECT * FROM fmap")
def q_feat_map(spark, sf_dir):
    return DemandChain(spark, sf_dir).feature_mapping()


@query("feature_pareto_report", ids="W4", sql=lambda: S.feature_report_sql(*FARGS))
def q_feat_report(spark, sf_dir):
    c = DemandChain(spark, sf_dir)
    return PA.feature_pareto_report(c.target("B"), c.feature_mapping(), PA.ITEM_COLS)
