"""N-week periods over the weekly summary (W2, J13, J18, AG7-AG9, AG16, AG26)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import first_value, mean, total
from .codes import MOST, Codes
from .weekly import ITEM_ATTRS

AVG_COLS = ["purchase_cost_amount", "purchase_mrp", "stock_prevailing_mrp", "transfer_cost_amount",
            "days_to_sell", "total_price", "line_discount", "crm_line_discount", "tax", "cost",
            "trade_incentive", "trade_incentive_value"]


def period_index(summary: DataFrame, n_weeks: int) -> DataFrame:
    """W2: number the distinct fiscal weeks by (year, week_no) and cut them into
    periods of ``n_weeks``: ``period = floor(row_number / n) + 1`` (0-based rows).

    The global ordering runs over the distinct weeks only (a few hundred rows
    for decades of data), never over the facts.
    """
    weeks = summary.select("year", "week_no", "week").distinct()
    w = Window.orderBy("year", "week_no", "week")
    return (weeks.withColumn("_rn", F.row_number().over(w) - 1)
                 .withColumn("period", (F.floor(F.col("_rn") / n_weeks) + 1).cast("int"))
                 .drop("_rn"))


def with_periods(summary: DataFrame, n_weeks: int, stores_to_remove: DataFrame | None = None,
                 codes: Codes | None = None) -> DataFrame:
    """J13 + J18 + PF5: drop non-stores (anti join), attach the period, zero-fill.

    ``codes``: those that the text of ``summary`` is held in; ``_week_at`` then numbers the weeks in their order.
    """
    df = summary
    if stores_to_remove is not None:
        gone = stores_to_remove.select("location_code")
        df = df.join(gone if codes is None else codes.encode(gone), "location_code", "left_anti")
    periods = period_index(df, n_weeks)
    if codes is not None:
        w = Window.orderBy("year", "week_no", "week")
        periods = periods.withColumn("_week_at", F.row_number().over(w).cast("long"))
    # one row per fiscal week: bounded by the calendar, safe to broadcast
    df = df.join(F.broadcast(periods), ["week", "year", "week_no"], "left")
    return (codes or Codes({})).fill(df)


def _rollup_aggs(group: list[str]) -> list:
    # where stores share a group: the first store (by code) of the first week, whatever the order of the rows
    opening = F.min_by("quantity", "_place")
    m = {c: mean(c) for c in AVG_COLS}
    disc = m["line_discount"] + m["crm_line_discount"]
    contribution = m["stock_prevailing_mrp"] - (m["line_discount"] + m["crm_line_discount"]
                                                 + m["tax"] + m["cost"])
    firsts = [c for c in ["location_code", "brand", "store_type", "store_location", "city_type",
                          "region", "state"] if c not in group]
    return [
        *[first_value(c).alias(c) for c in firsts],
        opening.alias("quantity"),
        total("purchase_quantity").alias("purchase_quantity"),
        total("transfer_quantity").alias("transfer_quantity"),
        (opening + F.sum("purchase_quantity") + F.sum("transfer_quantity")).cast("bigint")
            .alias("available_quantity"),
        total("sales_quantity").alias("sales_quantity"),
        m["purchase_cost_amount"].alias("purchase_cost_amount"),
        m["purchase_mrp"].alias("purchase_mrp"),
        first_value("purchase_date").alias("purchase_date"),
        m["stock_prevailing_mrp"].alias("stock_prevailing_mrp"),
        first_value("store_in").alias("store_in"),
        first_value("product_group_code").alias("product_group_code"),
        m["transfer_cost_amount"].alias("transfer_cost_amount"),
        first_value("sales_department").alias("sales_department"),
        m["days_to_sell"].alias("days_to_sell"),
        total("num_of_customers").alias("num_of_customers"),
        m["total_price"].alias("total_price"),
        m["line_discount"].alias("line_discount"),
        m["crm_line_discount"].alias("crm_line_discount"),
        disc.alias("discount"),
        m["tax"].alias("tax"),
        m["cost"].alias("cost"),
        (m["stock_prevailing_mrp"] - disc).alias("billing"),
        contribution.alias("contribution"),
        m["trade_incentive"].alias("trade_incentive"),
        m["trade_incentive_value"].alias("trade_incentive_value"),
        (contribution + m["trade_incentive_value"]).alias("total_contribution"),
        *[first_value(c).alias(c) for c in ITEM_ATTRS],
        first_value("area_code").alias("area_code"),
    ]


def _rolled_up(periodic: DataFrame, keys: list[str], written: DataFrame | None, codes: Codes | None = None) -> DataFrame:
    """Group with the carried text as codes; ``_place`` orders rows by year, week, store (as numbers where they are codes).

    The levels are read from ``written``, the table that ``periodic`` was derived from, or else from ``periodic`` itself.
    ``codes``: ``periodic`` holds these codes already (``with_periods`` with them).
    """
    if codes is not None:
        if "location_code" in codes.levels:
            place = F.col("_week_at") * (MOST + 1) + F.coalesce("location_code", F.lit(0))
        else:
            place = F.struct("_week_at", "location_code")
        return codes.decode(periodic.withColumn("_place", place).groupBy(*keys).agg(*_rollup_aggs(keys)))
    order = ["year", "week_no", "location_code"]
    text = [c for c, kind in periodic.dtypes if kind == "string" and c not in ("week", "closing_date")]
    codes = Codes.of([periodic if written is None else written], text)
    coded = {c: F.array_position(F.lit(codes.levels[c] or [""]), F.col(c)).cast("long") for c in order if c in codes.levels}
    if len(coded) == len(order):
        place = (coded["year"] * (MOST + 1) + coded["week_no"]) * (MOST + 1) + F.coalesce(coded["location_code"], F.lit(0))
    else:
        place = F.struct(*order)
    own = Codes({c: x for c, x in codes.levels.items() if c not in keys})
    return own.decode(own.encode(periodic.withColumn("_place", place)).groupBy(*keys).agg(*_rollup_aggs(keys)))


def rollup_by_store(periodic: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """AG7 + AG9: one row per (period, item, store). Opening stock is the
    quantity of the period's first week; flows are summed, money averaged."""
    return _rolled_up(periodic, ["period", "item_no", "location_code"], written)


def rollup_by_store_type(periodic: DataFrame, written: DataFrame | None = None, codes: Codes | None = None) -> DataFrame:
    """AG8 + AG9: one row per (period, item, state, store type). Opening stock is that of the group's first store
    (by code) in its first week; flows are summed over the stores, money averaged."""
    return _rolled_up(periodic, ["period", "item_no", "state", "store_type"], written, codes)


def stores_per_period(periodic: DataFrame) -> DataFrame:
    """AG16: distinct stores per (state, period, store type)."""
    return (periodic.groupBy("state", "period", "store_type")
                    .agg(F.count_distinct("location_code").alias("store_count")))


def sparsity_sweep(summary: DataFrame, n_from: int = 2, n_to: int = 13,
                   stores_to_remove: DataFrame | None = None) -> DataFrame:
    """AG26: for every period length N in [n_from, n_to], how many
    (period, item, store) cells have zero vs positive sales.

    One job for all N: sales are first reduced to one row per (item, store,
    week index); each row is replicated once per N (narrow ``explode``), and a
    single two-level aggregation counts the cells.
    """
    df = summary
    if stores_to_remove is not None:
        df = df.join(stores_to_remove.select("location_code"), "location_code", "left_anti")
    weeks = df.select("year", "week_no", "week").distinct()
    weeks = weeks.withColumn("_wi", F.row_number().over(Window.orderBy("year", "week_no", "week")) - 1)
    cells = (df.join(F.broadcast(weeks.select("week", "_wi")), "week")
               .groupBy("item_no", "location_code", "_wi")
               .agg(F.sum(F.coalesce("sales_quantity", F.lit(0))).alias("sq")))
    per = (cells.withColumn("week_agg_no", F.explode(F.sequence(F.lit(n_from), F.lit(n_to))))
                .withColumn("period", F.floor(F.col("_wi") / F.col("week_agg_no")) + 1)
                .groupBy("week_agg_no", "period", "item_no", "location_code")
                .agg(F.sum("sq").alias("sq")))
    out = (per.groupBy("week_agg_no")
              .agg(F.count(F.when(F.col("sq") == 0, 1)).alias("zero_sales"),
                   F.count(F.when(F.col("sq") > 0, 1)).alias("pos_sales")))
    tot = F.col("zero_sales") + F.col("pos_sales")
    return out.select("week_agg_no", "zero_sales", "pos_sales", tot.alias("total_count"),
                      (F.col("zero_sales").cast("double") * 100 / tot.cast("double")).alias("zero_percent"),
                      (F.col("pos_sales").cast("double") * 100 / tot.cast("double")).alias("pos_percent"))
