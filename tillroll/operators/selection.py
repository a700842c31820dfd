"""Exact selection of the first k rows in an order, without sorting the rows (FE6, FE7, SO3).

The order is that of a 60-bit row hash. The k-th value is found by refining a histogram: counts by the leading
bits say in which bucket it lies, counts within that bucket by the next bits, and so on. Each step is one
aggregation of at most ``2 ** STEP`` groups; most selections end after two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, STEP = 60, 15


def row_hash(seed: int, keys: list[str]) -> Column:
    """A row's place in a random order: 60 bits of an MD5 of the seed and the keys (the same in any SQL engine)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def row_hash_sql(seed: int, keys: list[str]) -> str:
    """:func:`row_hash` as DuckDB SQL."""
    text = ", ".join([f"'{seed}'"] + [f"coalesce(cast({k} as varchar), '-')" for k in keys])
    return f"cast('0x' || substr(md5(concat_ws('|', {text})), 1, {BITS // 4}) as bigint)"


def with_first(df: DataFrame, h: str, k: int, ties: list[str], col: str) -> DataFrame:
    """``df`` with ``col``: whether a row is one of the first ``k`` by ``h`` (0 to 2^60 - 1), then by ``ties``.

    Exactly ``min(k, rows)`` rows are. Only rows whose hash equals the k-th are ever numbered, and only where
    they do not all fit; rows with equal keys can be such, so keys should identify a row.
    """
    if k <= 0:
        return df.withColumn(col, F.lit(False))
    prefix, done, taken = 0, 0, 0
    while done < BITS:
        done += STEP
        own = df if done == STEP else df.where(F.shiftright(h, BITS - done + STEP) == prefix)
        counts = own.groupBy(F.shiftright(h, BITS - done).alias("b")).agg(F.count("*").alias("n")).collect()
        for r in sorted(counts, key=lambda r: r["b"]):
            if taken + r["n"] >= k:
                prefix = r["b"]
                break
            taken += r["n"]
        else:  # fewer than k rows
            return df.withColumn(col, F.lit(True))
        if taken + r["n"] == k:
            return df.withColumn(col, F.shiftright(h, BITS - done) <= prefix)
    w = Window.partitionBy(h).orderBy(*ties)
    equal = df.where(F.col(h) == prefix).withColumn(col, F.row_number().over(w) <= k - taken)
    return df.where(F.col(h) != prefix).withColumn(col, F.col(h) < prefix).unionByName(equal)
