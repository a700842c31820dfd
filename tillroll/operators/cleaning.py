"""Cleaning of text extracts (PF1, PF2, SC5, SC9, IO5): dates in several
formats, quantities such as '1.0', money with thousands separators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import money, parse_date, to_int
from ..sources.testdata import SALES_MONEY


def sales_as_text(sales_raw: DataFrame) -> DataFrame:
    """Render typed sales lines the way the source extracts look: sales dates
    alternate between 'yyyy/MM/dd' and 'dd/MM/yyyy', receipt dates use
    'dd/MM/yy', quantities read '1.0', money carries thousands separators."""
    alt = F.dayofmonth("sales_date") % 2 == 0
    return sales_raw.select(
        "location_code",
        F.when(alt, F.date_format("sales_date", "yyyy/MM/dd")).otherwise(F.date_format("sales_date", "dd/MM/yyyy"))
         .alias("sales_date"),
        F.col("item_no").cast("string").alias("item_no"), "customer_no", "brand", "sales_department",
        F.concat(F.col("quantity").cast("string"), F.lit(".0")).alias("quantity"),
        *[F.format_number(F.col(c), 4).alias(c) for c in SALES_MONEY],
        F.date_format("receipt_date", "dd/MM/yy").alias("receipt_date"), "state", "region")


def clean_sales_text(text: DataFrame) -> DataFrame:
    """PF1: typed sales lines from a text extract (no ANSI errors: bad values become NULL)."""
    return text.select(
        "location_code", parse_date("sales_date", ("yyyy/MM/dd", "dd/MM/yyyy")).alias("sales_date"),
        F.col("item_no").try_cast("long").alias("item_no"), "customer_no", "brand", "sales_department",
        to_int("quantity").alias("quantity"),
        *[money(c).cast("decimal(18,4)").alias(c) if c != "price" else money(c).cast("decimal(18,2)").alias(c)
          for c in SALES_MONEY],
        parse_date("receipt_date", ("dd/MM/yy",)).alias("receipt_date"), "state", "region")
