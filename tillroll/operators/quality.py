"""Data-quality operators: null audits (AG23-AG25), blank/default handling
(PF7, PF8), the gender rule (PF21/DQ3), conservation tallies (DQ5), unmapped
and duplicate keys (DQ6, DQ8, SE6, J14-J16), level frequencies and modes
(AG21, AG22), never-sold items (AG18) and returns matching (DQ4, J20, PF16)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import null_count_per_row

IMPUTE_ATTRS = ["strap_color", "case_size_range", "glass", "dial_color", "strap_type", "case_shape",
                "material", "case_size", "movement"]
AUDIT_ATTRS = ["brand", "case_size", "case_size_range", "gender", "movement", "material", "dial_color",
               "strap_type", "strap_color", "precious_stone", "glass", "case_shape", "watch_type"]


def exact_sum(c: str):
    """Sum taken in decimal(38,8): order-independent (exact for money on that grid)."""
    return F.sum(F.col(c).cast("decimal(38,8)")).cast("double")


def blank_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """PF8: empty strings become NULL (string columns only)."""
    types = dict(df.dtypes)
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in cols and types[c] == "string"
                       else F.col(c) for c in df.columns])


def gender_rule(df: DataFrame, size_col: str = "case_size", threshold: float = 38) -> DataFrame:
    """PF21: case size above the threshold → 'Men' (overrides a known value);
    otherwise blank or NULL → 'Women'."""
    g = (F.when(F.col(size_col) > threshold, F.lit("Men"))
          .when(F.col("gender").isNull() | (F.col("gender") == ""), F.lit("Women"))
          .otherwise(F.col("gender")))
    return df.withColumn("gender", g)


def item_master_for_imputation(summary: DataFrame, item_master: DataFrame) -> DataFrame:
    """J16 + PF7 + AG24: attributes of every transacted item (right outer join
    to the per-item summary totals), precious stone defaulted to 'no', and the
    number of NULL cells per row."""
    totals = summary.groupBy("item_no").agg(exact_sum("stock_prevailing_mrp").alias("mrp"),
                                            F.sum("sales_quantity").cast("bigint").alias("sales_quantity"))
    j = item_master.join(totals, "item_no", "right_outer").fillna({"precious_stone": "no"})
    return j.withColumn("null_cnt", null_count_per_row(j.columns))


def null_impact_report(master: DataFrame, attrs: list[str] | None = None) -> DataFrame:
    """AG25: for each attribute with NULLs, the rows, MRP, sales quantity and
    NULL cells that the NULL level carries (absolute and as % of the total),
    plus an 'All Nulls' row (rows with any NULL) and a 'Total' row.

    One pass over the table: every figure is a conditional sum in a single
    global aggregation (partial per partition), unpivoted afterwards.
    """
    attrs = [a for a in (attrs or AUDIT_ATTRS) if a in master.columns]
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in master.columns])
    mrp = F.col("mrp").cast("decimal(38,8)")
    aggs = [F.count("*").alias("t_rows"), F.sum(mrp).alias("t_mrp"),
            F.sum("sales_quantity").alias("t_sq"), F.sum("null_cnt").alias("t_nc"),
            F.count(F.when(any_null, 1)).alias("a_rows"), F.sum(F.when(any_null, mrp)).alias("a_mrp"),
            F.sum(F.when(any_null, F.col("sales_quantity"))).alias("a_sq"),
            F.sum(F.when(any_null, F.col("null_cnt"))).alias("a_nc")]
    for i, c in enumerate(attrs):
        isn = F.col(c).isNull()
        aggs += [F.count(F.when(isn, 1)).alias(f"r{i}"), F.sum(F.when(isn, mrp)).alias(f"m{i}"),
                 F.sum(F.when(isn, F.col("sales_quantity"))).alias(f"s{i}"),
                 F.sum(F.when(isn, F.col("null_cnt"))).alias(f"n{i}")]
    one = master.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("rows"), F.col(f"m{i}").alias("mrp"),
                     F.col(f"s{i}").alias("sq"), F.col(f"n{i}").alias("nc")) for i, c in enumerate(attrs)]
    rows += [F.struct(F.lit("All Nulls").alias("feature"), F.col("a_rows").alias("rows"),
                      F.col("a_mrp").alias("mrp"), F.col("a_sq").alias("sq"), F.col("a_nc").alias("nc")),
             F.struct(F.lit("Total").alias("feature"), F.col("t_rows").alias("rows"),
                      F.col("t_mrp").alias("mrp"), F.col("t_sq").alias("sq"), F.col("t_nc").alias("nc"))]
    long = one.select("t_rows", "t_mrp", "t_sq", "t_nc", F.explode(F.array(*rows)).alias("r"))

    def pct(x, t):
        return F.try_divide(F.col(x).cast("double") * 100, F.col(t).cast("double"))

    return (long.select(F.col("r.feature").alias("feature"), F.col("r.rows").alias("row_count"),
                        F.col("r.mrp").cast("double").alias("mrp"),
                        F.col("r.sq").cast("bigint").alias("sales_quantity"),
                        F.col("r.nc").cast("bigint").alias("null_cnt"), "t_rows", "t_mrp", "t_sq", "t_nc")
                .where(F.col("row_count") > 0)
                .select("feature", "row_count", "mrp", "sales_quantity", "null_cnt",
                        pct("row_count", "t_rows").alias("row_pct"), pct("mrp", "t_mrp").alias("mrp_pct"),
                        pct("sales_quantity", "t_sq").alias("sales_qty_pct"),
                        pct("null_cnt", "t_nc").alias("null_count_pct")))


def null_audit(df: DataFrame) -> DataFrame:
    """AG23 in long form: (column, null_count) for every column, one pass."""
    one = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("null_count"))
             for i, c in enumerate(df.columns)]
    return one.select(F.explode(F.array(*pairs)).alias("p")).select("p.column_name", "p.null_count")


def conservation(before: dict[str, tuple[DataFrame, str]], after: DataFrame) -> DataFrame:
    """DQ5: for each measure, its total before the merge and after it.

    ``before`` maps an output column of ``after`` to (source frame, column).
    All totals come from one ``groupBy(measure)`` over a union of narrow
    projections (no joins), with exact decimal sums.
    """
    parts = []
    for m, (src, c) in before.items():
        parts.append(src.select(F.lit(m).alias("measure"), F.col(c).cast("decimal(38,8)").alias("b"),
                                F.lit(None).cast("decimal(38,8)").alias("a")))
        parts.append(after.select(F.lit(m).alias("measure"), F.lit(None).cast("decimal(38,8)").alias("b"),
                                  F.col(m).cast("decimal(38,8)").alias("a")))
    u = reduce(lambda x, y: x.unionByName(y), parts)
    g = u.groupBy("measure").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    return g.select("measure", F.col("b").cast("double").alias("before"),
                    F.col("a").cast("double").alias("after"),
                    (F.coalesce(F.col("b"), F.lit(0)) == F.coalesce(F.col("a"), F.lit(0))).alias("conserved"))


def unmapped_keys(facts: DataFrame, master: DataFrame, fact_key: str, master_key: str) -> DataFrame:
    """DQ6: fact keys that have no master row, with the fact rows that carry them."""
    k = facts.where(F.col(fact_key).isNotNull()).groupBy(F.col(fact_key).alias("key")).agg(F.count("*").alias("fact_rows"))
    return k.join(master.select(F.col(master_key).alias("key")), "key", "left_anti")


def facts_without_summary(facts: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """J14: fact rows, summed by ``keys``, whose key the summary does not hold (null keys never match)."""
    per = facts.groupBy(*keys).agg(F.count("*").alias("fact_rows"), F.sum("quantity").cast("bigint").alias("quantity"))
    return per.join(summary.select(*keys), keys, "left_anti")


def key_set_sizes(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """SE6: how many distinct keys both frames hold, and how many only one of them."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    parts = [("both", x.intersect(y)), ("first_only", x.subtract(y)), ("second_only", y.subtract(x))]
    sized = [part.select(F.lit(name).alias("side")) for name, part in parts]
    return reduce(lambda p, q: p.unionByName(q), sized).groupBy("side").agg(F.count("*").alias("keys"))


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    """DQ8: rows vs distinct keys (one row)."""
    return df.agg(F.count("*").alias("row_count"), F.count_distinct(key).alias("distinct_keys"))


def level_frequency(df: DataFrame, col: str, weight: str | None = None) -> DataFrame:
    """AG21 + W5: count (and optional weight sum) per level and its share of the total.

    The grand total is one scalar (a single-row aggregate read by the driver)
    used as a literal: no single-partition window and no join.
    """
    aggs = [F.count("*").alias("n")]
    if weight:
        aggs.append(F.sum(F.col(weight).cast("decimal(38,8)")).alias("w"))
    g = df.groupBy(col).agg(*aggs)
    tots = [F.sum("n").alias("tn")] + ([F.sum("w").alias("tw")] if weight else [])
    tot = g.agg(*tots).head()
    out = g.withColumn("pct", F.col("n").cast("double") * 100 / F.lit(float(tot["tn"] or 0)))
    if weight:
        tw = F.lit(tot["tw"]).cast("decimal(38,8)").cast("double")
        out = out.withColumn("weight_pct", F.col("w").cast("double") * 100 / tw) \
                 .withColumn(f"{weight}_sum", F.col("w").cast("double")).drop("w")
    return out.withColumnRenamed(col, "level")


def never_sold_items(summary: DataFrame) -> DataFrame:
    """AG18: items whose total sales are zero."""
    return (summary.groupBy("item_no").agg(F.sum("sales_quantity").alias("s"))
                   .where(F.col("s") == 0).select("item_no"))


def drop_never_sold(summary: DataFrame) -> DataFrame:
    # a hash of the few items, so rows that lie by item are neither shuffled nor sorted
    return summary.join(never_sold_items(summary).hint("shuffle_hash"), "item_no", "left_anti")


def weekly_signed_sales(sales_raw: DataFrame) -> DataFrame:
    """Sales quantity per (item, store, Monday week) with returns kept (negative)."""
    return (sales_raw.withColumn("week_start", F.to_date(F.date_trunc("week", "sales_date")))
                     .groupBy("item_no", "location_code", "week_start")
                     .agg(F.sum("quantity").cast("bigint").alias("sales_qty_in_week"))
                     .withColumn("col_pk", F.concat_ws("_", F.col("item_no").cast("string"), "location_code")))


def sign_buckets(weekly: DataFrame) -> DataFrame:
    """PF16: positive / negative / zero weeks."""
    b = F.when(F.col("sales_qty_in_week") > 0, "positive").when(F.col("sales_qty_in_week") < 0, "negative") \
         .otherwise("zero")
    return weekly.groupBy(b.alias("bucket")).agg(F.count("*").alias("weeks"))


def match_returns(weekly: DataFrame) -> DataFrame:
    """DQ4 / J20: a negative week matched to a positive sale of the same
    item-store exactly one week earlier. One equi-join on (key, week - 7);
    both sides are unique per (key, week), so a hot key cannot fan out."""
    neg = weekly.where(F.col("sales_qty_in_week") < 0).select(
        "col_pk", "item_no", "location_code", "week_start",
        F.date_sub("week_start", 7).alias("prev_week_start"),
        F.col("sales_qty_in_week").alias("returned_quantity"))
    pos = weekly.where(F.col("sales_qty_in_week") > 0).select(
        F.col("col_pk").alias("_pk"), F.col("week_start").alias("_ws"),
        F.col("sales_qty_in_week").alias("sold_quantity_prev_week"))
    j = neg.join(pos, (neg.col_pk == pos._pk) & (neg.prev_week_start == pos._ws))
    return j.drop("_pk", "_ws")
