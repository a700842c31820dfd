"""Grid, returns and data-quality family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fiscal import week_label
from ..operators import grid, quality
from ..operators.fuzzy import fuzzy_level_matches
from ..operators.weekly import WeeklySummary
from ..sources.testdata import RetailTables
from . import sql_quality as S
from .catalog import query

FUZZY_ATTRS = ["dial_color", "case_shape", "material", "strap_color", "case_size_range"]


@query("weekly_grid", ids="SE3 J10 J11 J12 J22 AG10 AG12 PF6 PF13 PF17 PF18 U1 SC7", sql=S.grid_sql)
def q_grid(spark, sf_dir):
    t = RetailTables(spark, sf_dir)
    return grid.weekly_grid(t.closing_stock_raw, t.sales_raw, t.purchase_raw, t.store_master, t.item_master)


@query("bulk_orders", ids="AG13 DQ7 PF17", sql=S.bulk_orders_sql)
def q_bulk(spark, sf_dir):
    return grid.customer_day_quantity(RetailTables(spark, sf_dir).sales_raw, "raw_quantity")


@query("returns_matching", ids="DQ4 J20 SC6", sql=S.returns_sql)
def q_returns(spark, sf_dir):
    return quality.match_returns(quality.weekly_signed_sales(RetailTables(spark, sf_dir).sales_raw))


@query("sales_sign_buckets", ids="PF16", sql=S.sign_buckets_sql)
def q_sign(spark, sf_dir):
    return quality.sign_buckets(quality.weekly_signed_sales(RetailTables(spark, sf_dir).sales_raw))


def _imputation_input(spark, sf_dir):
    t = RetailTables(spark, sf_dir, "sku")
    return quality.item_master_for_imputation(WeeklySummary(t).summary(materialized=True), t.item_master)


@query("item_master_for_imputation", ids="J16 PF7 AG24 U2",
       sql=lambda: S.imputation_input_ctes() + "\nSELECT * FROM imf")
def q_imf(spark, sf_dir):
    return _imputation_input(spark, sf_dir)


@query("null_impact_report", ids="AG25 SC9", sql=S.null_impact_sql)
def q_null_impact(spark, sf_dir):
    return quality.null_impact_report(_imputation_input(spark, sf_dir))


@query("null_audit", ids="AG23", sql=S.null_audit_sql)
def q_null_audit(spark, sf_dir):
    return quality.null_audit(WeeklySummary(RetailTables(spark, sf_dir)).summary())


@query("conservation", ids="DQ5 AG14", sql=S.conservation_sql)
def q_conservation(spark, sf_dir):
    ws = WeeklySummary(RetailTables(spark, sf_dir))
    before = {"quantity": (ws.stock, "quantity"), "purchase_quantity": (ws.purchase_w, "quantity"),
              "transfer_quantity": (ws.transfer_w, "quantity"), "sales_quantity": (ws.sales_w, "quantity")}
    return quality.conservation(before, ws.summary())


@query("unmapped_stores", ids="DQ6", sql=S.unmapped_stores_sql)
def q_unmapped_stores(spark, sf_dir):
    """Stores of the four facts that the cleaned store master (non-stores removed) does not hold."""
    t = RetailTables(spark, sf_dir)
    stores = t.store_master.join(t.stores_to_be_removed, F.col("store_code") == F.col("location_code"), "left_anti")
    codes = [t.closing_stock_raw.select("location_code"), t.purchase_raw.select("location_code"),
             t.transfer_raw.select(F.col("store_in").alias("location_code")), t.sales_raw.select("location_code")]
    facts = codes[0].unionByName(codes[1]).unionByName(codes[2]).unionByName(codes[3])
    return quality.unmapped_keys(facts, stores, "location_code", "store_code")


@query("sales_without_summary", ids="J14", sql=S.sales_without_summary_sql)
def q_sales_without_summary(spark, sf_dir):
    """Raw sales (returns and bulk lines included) in cells that the weekly summary does not hold."""
    ws = WeeklySummary(RetailTables(spark, sf_dir))
    raw = ws.t.sales_raw.where("sales_date is not null").withColumn("week", week_label("sales_date"))
    return quality.facts_without_summary(raw, ws.summary(materialized=True), ["location_code", "item_no", "week"])


@query("stock_sales_key_sets", ids="SE6", sql=S.stock_sales_key_sets_sql)
def q_key_sets(spark, sf_dir):
    t = RetailTables(spark, sf_dir, "sku")
    return quality.key_set_sizes(t.closing_stock_raw, t.sales_raw, ["location_code", "item_no"])


@query("item_key_uniqueness", ids="DQ8", sql=S.key_uniqueness_sql)
def q_keys(spark, sf_dir):
    return quality.key_uniqueness(RetailTables(spark, sf_dir, "sku").item_master, "item_no")


@query("never_sold_items", ids="AG18", sql=S.never_sold_sql)
def q_never_sold(spark, sf_dir):
    return quality.never_sold_items(WeeklySummary(RetailTables(spark, sf_dir, "sku")).summary())


@query("store_type_frequency", ids="AG21 W5", sql=S.level_frequency_sql)
def q_freq(spark, sf_dir):
    return quality.level_frequency(WeeklySummary(RetailTables(spark, sf_dir)).summary(), "store_type", "billing")


@query("attribute_modes", ids="AG22", sql=S.modes_sql)
def q_modes(spark, sf_dir):
    im = RetailTables(spark, sf_dir, "sku").item_master
    one = im.agg(*[F.mode(F.col(a).cast("string"), deterministic=True).alias(a) for a in S.ATTRS])
    pairs = [F.struct(F.lit(a).alias("attribute"), F.col(a).alias("mode_value")) for a in S.ATTRS]
    return one.select(F.explode(F.array(*pairs)).alias("p")).select("p.attribute", "p.mode_value")


@query("fuzzy_levels", ids="DQ1", sql=lambda: S.fuzzy_sql(FUZZY_ATTRS, 0.6, 3))
def q_fuzzy(spark, sf_dir):
    return fuzzy_level_matches(RetailTables(spark, sf_dir, "sku").item_master, FUZZY_ATTRS, 0.6, 3)
