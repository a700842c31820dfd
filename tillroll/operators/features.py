"""Model inputs: labels, splits, oversampling, one-hot encoding, level
alignment and scoring frames (FE4-FE10, PF17, PF22, SO3)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import row_hash, with_first

#: fixed values: the attributes that are one-hot encoded, the numbers beside them, and those that make a SKU
CAT_COLS = ["store_type", "store_location", "city_type", "state", "region", "brand", "case_size_range", "gender", "movement", "material",
            "dial_color", "strap_type", "strap_color", "precious_stone", "glass", "case_shape", "watch_type"]
NUM_COLS = ["stock_prevailing_mrp", "case_size", "available_quantity"]
SKU_COLS = ["item_no", "brand", "case_size_range", "gender", "movement", "material", "dial_color", "strap_type",
            "strap_color", "precious_stone", "glass", "case_shape", "watch_type"]


def with_sales_class(df: DataFrame, qty: str = "sales_quantity", out: str = "sales_class") -> DataFrame:
    """PF17: 1 when something sold, else 0 (NULL compares as 0)."""
    return df.withColumn(out, F.when(F.col(qty) > 0, 1).otherwise(0))


def hash_split(df: DataFrame, keys: list[str], train_pct: int = 80, seed: int = 42,
               col: str = "is_train") -> DataFrame:
    """FE6: repeatable random split: ``row_hash(seed, keys) mod 100 < train_pct``.
    Row-local (no shuffle, no sort); the same row lands on the same side on
    every run, cluster size and engine."""
    return df.withColumn(col, row_hash(seed, keys) % 100 < train_pct)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """FE8: rows per class."""
    return df.groupBy(label).agg(F.count("*").alias("rows"))


def oversample(df: DataFrame, label: str, keys: list[str], seed: int = 42) -> DataFrame:
    """FE7: random oversampling of every smaller class to exactly the size of the largest.

    Every row of a class is replicated ``n_major div n`` times (a narrow ``explode``); the remaining
    ``n_major mod n`` copies are of as many rows, the first in a random order (``selection.with_first``: histograms of a
    hash, no sort). Only class counts and histograms reach the driver.
    """
    counts = {r[label]: r["rows"] for r in class_counts(df, label).collect()}
    if len(counts) < 2:
        return df
    most = max(counts.values())
    out = df.where(F.col(label).isin([c for c in counts if counts[c] == most]))
    for c in sorted((c for c in counts if counts[c] < most), key=str):
        reps, rest = divmod(most, counts[c])
        own = df.where(F.col(label) == c).withColumn("_h", row_hash(seed + 1, keys))
        own = with_first(own, "_h", rest, keys, "_more")
        copies = F.when(F.col("_more"), reps + 1).otherwise(reps)
        out = out.unionByName(own.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy", "_more", "_h"))
    return out


def one_hot_pipeline(cat_cols: list[str] | None = None, num_cols: list[str] | None = None,
                     out: str = "features") -> Pipeline:
    """FE4: index (unseen levels kept), one-hot (no level dropped), assemble."""
    cat_cols = CAT_COLS if cat_cols is None else cat_cols
    num_cols = NUM_COLS if num_cols is None else num_cols
    idx = [f"{c}__idx" for c in cat_cols]
    vec = [f"{c}__vec" for c in cat_cols]
    return Pipeline(stages=[
        StringIndexer(inputCols=cat_cols, outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx, outputCols=vec, dropLast=False, handleInvalid="keep"),
        VectorAssembler(inputCols=vec + num_cols, outputCol=out, handleInvalid="keep"),
    ])


def prepare(df: DataFrame, cat_cols: list[str] | None = None, num_cols: list[str] | None = None) -> DataFrame:
    """Categoricals as strings with NULL → 'nan' (the source casts to str), numbers as double."""
    cat_cols = cat_cols or CAT_COLS
    num_cols = num_cols or NUM_COLS
    out = df
    for c in [c for c in cat_cols if c in df.columns]:
        out = out.withColumn(c, F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("nan")))
    for c in [c for c in num_cols if c in df.columns]:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return out


def level_alignment(train: DataFrame, score: DataFrame, cols: list[str]) -> DataFrame:
    """FE5: (feature, level, side) for levels seen only in training or only in scoring (a null level is no other's equal).

    Either frame is read once for all of ``cols``, and sides are compared by one aggregation of levels: what the frames
    are joined from is not planned, and broadcast, again for every feature and side.
    """
    def levels(df, side):
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in cols])
        return df.select(F.explode(pairs).alias("x")).select("x.*", *[F.lit(s == side).alias(s) for s in sides])
    sides = ["train_only", "score_only"]
    both = levels(train, sides[0]).unionByName(levels(score, sides[1])).groupBy("feature", "level").agg(*[F.max(s).alias(s) for s in sides])
    alone = F.col("level").isNull() | (F.col(sides[0]) != F.col(sides[1]))
    found = F.filter(F.array(*[F.when(F.col(s) & alone, F.lit(s)) for s in sides]), lambda x: x.isNotNull())
    return both.select("feature", "level", F.explode(found).alias("side"))


def unique_sku_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """FE9: distinct SKU attribute rows."""
    return df.select(*(cols or SKU_COLS)).distinct()


def scoring_frame(candidates: DataFrame, store_master: DataFrame, item_master: DataFrame,
                  period: int) -> DataFrame:
    """FE10: every SKU retailed at a store with the store's attributes and the
    SKU's attributes for one period. Built from (store, SKU) pairs that exist,
    with equi-joins to both dimensions (no store x SKU product)."""
    st = store_master.select(F.col("store_code").alias("location_code"), "store_type", "store_location",
                             "city_type", "state", "region")
    return (candidates.join(st, "location_code", "inner")
                      .join(item_master, "item_no", "left")
                      .withColumn("period", F.lit(period)))


def latest_features(df: DataFrame, keys: list[str], cols: list[str], order_col: str = "period") -> DataFrame:
    """J21: per key, the mean of ``cols`` in the key's last period (what is known when the next one is scored)."""
    last = df.groupBy(*keys).agg(F.max(order_col).alias(order_col))
    return df.join(last, [*keys, order_col]).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def ordered_split(df: DataFrame, keys: list[str], test_share: float = 0.2, order_col: str = "period",
                  col: str = "is_train", seed: int = 42) -> DataFrame:
    """SO3: ordered split of rows: of n rows by ``order_col`` the last ``int(n * test_share)`` are test rows, the others train.

    Rows of the period in which the cut falls come in the order of their row hash. Counts per period are one
    small aggregate, the place within the period is found by histograms: no global sort of the rows, and
    exact sizes whatever the periods hold. Rows without a period come first.
    """
    per = sorted(((r[order_col], r["n"]) for r in df.groupBy(order_col).agg(F.count("*").alias("n")).collect()),
                 key=lambda x: (x[0] is not None, x[0]))
    n = sum(c for _, c in per)
    left = n - int(n * test_share)
    whole = []
    for period, c in per:
        if c > left:
            break
        whole.append(period)
        left -= c
    else:
        return df.withColumn(col, F.lit(True))
    at = F.col(order_col).eqNullSafe(F.lit(period))
    before = F.col(order_col).isin([p for p in whole if p is not None]) | (F.col(order_col).isNull() & F.lit(None in whole))
    cut = with_first(df.where(at).withColumn("_h", row_hash(seed, keys)), "_h", left, keys, col).drop("_h")
    return df.where(~at).withColumn(col, F.coalesce(before, F.lit(False))).unionByName(cut)


def drop_incomplete_last_period(df: DataFrame, periods: DataFrame, n_weeks: int) -> DataFrame:
    """PF22: drop the last period when it holds fewer than ``n_weeks`` weeks
    (``periods`` is the week → period index, one row per week)."""
    per = periods.groupBy("period").agg(F.count("*").alias("_w"))
    last = per.agg(F.max_by("period", "period").alias("_p"), F.max_by("_w", "period").alias("_w"))
    bad = last.where(F.col("_w") < n_weeks).select(F.col("_p").alias("period"))
    return df.join(F.broadcast(bad), "period", "left_anti")
