"""Sources, sinks and the streaming wrapper."""

from __future__ import annotations

from ..sources import files as IO
from ..sources.testdata import RetailTables
from ..streaming.weekly_files import weekly_stock_via_stream
from . import sql_weekly as W
from .catalog import query


@query("stream_weekly_stock", ids="IO2 IO7 IO8 AG1 SC2",
       sql=lambda: W.fact_ctes() + "\nSELECT * FROM closing_stock")
def q_stream(spark, sf_dir):
    return weekly_stock_via_stream(spark, RetailTables(spark, sf_dir).closing_stock_raw)


@query("weekly_file_scan", ids="IO1 IO2 IO3 IO4 IO5",
       sql=lambda: W.fact_ctes() + """
SELECT closing_date AS file_week, count(*) AS rows, cast(sum(quantity) as bigint) AS quantity
FROM closing_stock_raw WHERE closing_date IS NOT NULL GROUP BY closing_date""")
def q_scan(spark, sf_dir):
    from pyspark.sql import functions as F
    t = RetailTables(spark, sf_dir)
    path = IO.shared_scratch(spark, "week-files")
    IO.write_weekly_files(t.closing_stock_raw.where("closing_date IS NOT NULL"), "closing_date", path)
    df = IO.read_weekly_files(spark, path, IO.CLOSING_STOCK_SCHEMA)
    df = IO.rename_positional(df, [f"field{i}" for i in range(len(df.columns) - 1)] + ["file_week"])
    on_hand = f"field{IO.CLOSING_STOCK_SCHEMA.names.index('quantity')}"
    return df.groupBy("file_week").agg(F.count("*").alias("rows"), F.sum(on_hand).cast("bigint").alias("quantity"))
