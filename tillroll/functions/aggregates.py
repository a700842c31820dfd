"""Aggregate and cleaning expressions shared by the operators."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


MEAN_SCALE = 100000000  # means are fixed-point with 8 decimals


def units_sql(c: str) -> str:
    """Value in 1e-8 units as bigint. Inputs are decimals of scale <= 8 or
    means already on the 1e-8 grid, so ``x * 1e8`` is within far less than
    0.5 of an integer and ``floor(.. + 0.5)`` recovers it; all of it is plain
    double/long arithmetic (no BigDecimal per row), identical in any engine."""
    return f"cast(floor(cast({c} as double) * {MEAN_SCALE} + 0.5) as bigint)"


def mean_sql(c: str) -> str:
    """SQL text of :func:`mean` (valid in Spark SQL and DuckDB)."""
    u = f"sum({units_sql(c)})"
    n = f"count({c})"
    q = (f"CASE WHEN {u} < 0 THEN -((-{u} * 2 + {n}) div nullif(2 * {n}, 0)) "
         f"ELSE ({u} * 2 + {n}) div nullif(2 * {n}, 0) END")
    return f"cast({q} as double) / {MEAN_SCALE}"


def mean(c: str) -> Column:
    """Average rounded half-up to 8 decimals, computed in integer arithmetic.

    Every value is taken as an exact multiple of 1e-8 (money is decimal, and
    means of means are again on that grid), summed as bigint and divided once
    with half-up rounding. The result does not depend on summation order, so
    it is identical across partitionings, reruns and engines (a plain double
    ``avg`` of averages is not). All-null groups give NULL; bigint overflow
    (group sums above ~4.6e10) fails loudly under ANSI mode.
    """
    return F.expr(mean_sql(c))


def mean_of_one(c: str) -> Column:
    """:func:`mean` of a group of one row."""
    return F.expr(f"cast({units_sql(c)} as double) / {MEAN_SCALE}")


def first_value(c: Column | str) -> Column:
    """Deterministic stand-in for an order-dependent ``first()``: the minimum."""
    return F.min(col(c))


def total(c: Column | str) -> Column:
    """Integer sum widened to bigint."""
    return F.sum(col(c)).cast("bigint")


def null_count_per_row(cols: list[str]) -> Column:
    """Number of NULL cells in a row over ``cols`` (AG24)."""
    return reduce(add, [F.col(c).isNull().cast("int") for c in cols])


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row: NULL count per column (AG23)."""
    cols = cols or df.columns
    return df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def to_int(c: Column | str) -> Column:
    """String/float quantity to int without ANSI errors (``'1.0'`` → 1, blank → NULL)."""
    c = col(c)
    return c.try_cast("double").cast("int")


def parse_date(c: Column | str, formats: tuple[str, ...] = ("yyyy/MM/dd", "dd/MM/yyyy", "dd/MM/yy")) -> Column:
    """First format that parses; NULL when none does (SC5)."""
    c = col(c)
    return F.coalesce(*[F.try_to_date(c, fmt) for fmt in formats])


def money(c: Column | str) -> Column:
    """Text money with thousands separators (SC9): ``'1,234.5'`` → 1234.5 (decimal(38,8))."""
    return F.regexp_replace(col(c).cast("string"), ",", "").try_cast("decimal(38,8)")
