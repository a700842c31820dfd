"""Fiscal week labels ``Www-FYyyzz`` as built-in column expressions.

The label of a date ``d`` is built from ``e = d - shift`` days:
``'W' || lpad(weekofyear(e), 2, '0') || '-FY' || year(e) % 100 || (year(e) % 100 + 1)``.
``weekofyear`` is the ISO week; the year is the calendar year and is not
zero-padded, as in the source data. A handful of dates around the fiscal
year end carry fixed labels that the formula does not produce.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literal label overrides for transaction flows
# (purchases, transfers, sales), formula shift 91 days.
FLOW_SHIFT = 91
FLOW_OVERRIDES = {
    "2017-04-02": "W52-FY1617",
    "2019-03-31": "W52-FY1819",
    "2019-04-01": "W01-FY1920",
    "2020-03-29": "W52-FY1920",
    "2020-03-30": "W53-FY1920",
    "2020-03-31": "W53-FY1920",
}

# Literal label overrides for closing stock, shift 90 days
# (a Sunday close is the opening stock of the following week).
STOCK_SHIFT = 90
STOCK_OVERRIDES = {
    "2019-03-31": "W01-FY1920",
    "2020-03-29": "W53-FY1920",
}


def _formula(d: Column, shift: int) -> Column:
    e = F.date_sub(d, shift)
    yy = F.year(e) % 100
    return F.concat(
        F.lit("W"), F.lpad(F.weekofyear(e).cast("string"), 2, "0"),
        F.lit("-FY"), yy.cast("string"), (yy + 1).cast("string"))


def week_label(d: Column | str, shift: int = FLOW_SHIFT,
               overrides: dict[str, str] | None = None) -> Column:
    """Fiscal week label of date column ``d`` (a CASE chain, constant-folded)."""
    d = F.col(d) if isinstance(d, str) else d
    if overrides is None:
        overrides = FLOW_OVERRIDES if shift == FLOW_SHIFT else {}
    expr = None
    for day, label in sorted(overrides.items()):
        cond = d == F.lit(_dt.date.fromisoformat(day))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    base = _formula(d, shift)
    return base if expr is None else expr.otherwise(base)


def stock_week_label(d: Column | str) -> Column:
    return week_label(d, STOCK_SHIFT, STOCK_OVERRIDES)


def week_no(label: Column | str) -> Column:
    """``W05`` part of a label (first three characters)."""
    label = F.col(label) if isinstance(label, str) else label
    return F.substring(label, 1, 3)


def fiscal_year(label: Column | str) -> Column:
    """``FY1920`` part of a label (from the fifth character)."""
    label = F.col(label) if isinstance(label, str) else label
    return F.substring(label, 5, 100)


def fiscal_parts(d: Column | str, shift: int = FLOW_SHIFT) -> dict[str, Column]:
    """Fiscal month / week / two-digit year integers of a date (SC3)."""
    d = F.col(d) if isinstance(d, str) else d
    e = F.date_sub(d, shift)
    return {"fiscal_month": F.month(e), "fiscal_week": F.weekofyear(e),
            "fiscal_year": F.year(e) % 100}


def sql_week_label(col: str, shift: int = FLOW_SHIFT,
                   overrides: dict[str, str] | None = None) -> str:
    """The same label as DuckDB/ANSI SQL text (used by the oracles)."""
    if overrides is None:
        overrides = FLOW_OVERRIDES if shift == FLOW_SHIFT else {}
    e = f"({col} - {shift})"
    base = (f"concat('W', lpad(cast(weekofyear({e}) as varchar), 2, '0'), '-FY', "
            f"cast(year({e}) % 100 as varchar), cast(year({e}) % 100 + 1 as varchar))")
    if not overrides:
        return base
    whens = " ".join(f"WHEN {col} = DATE '{d}' THEN '{lab}'" for d, lab in sorted(overrides.items()))
    return f"(CASE {whens} ELSE {base} END)"
