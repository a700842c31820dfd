"""File sources and sinks (IO1-IO9): CSV with explicit schemas, dated weekly
file sets, positional renames, partitioned / single-file / append sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

# Input schemas of the retail tables (no inference: one scan, exact types).
CLOSING_STOCK_SCHEMA = T.StructType([
    T.StructField("location_code", T.StringType()), T.StructField("item_no", T.LongType()),
    T.StructField("closing_date", T.DateType()), T.StructField("brand", T.StringType()),
    T.StructField("department", T.StringType()), T.StructField("quantity", T.IntegerType()),
    T.StructField("cost_amount", T.DecimalType(18, 4)), T.StructField("purchase_mrp", T.DecimalType(18, 2)),
    T.StructField("stock_prevailing_mrp", T.DecimalType(18, 4)), T.StructField("purchase_date", T.DateType()),
    T.StructField("state", T.StringType()), T.StructField("region", T.StringType())])

WEEK_IN_NAME = r"(\d{2}\.\d{2}\.\d{2})"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True,
             ignore_corrupt: bool = True) -> DataFrame:
    """IO1 + IO3: CSV scan with an explicit schema; malformed lines become NULL
    fields (PERMISSIVE) and unreadable files are skipped."""
    return (spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
            .option("ignoreCorruptFiles", ignore_corrupt).csv(path))


def rename_positional(df: DataFrame, names: list[str]) -> DataFrame:
    """IO5: rename columns by position."""
    return df.toDF(*names)


def with_file_week(df: DataFrame, col: str = "file_week", pattern: str = WEEK_IN_NAME,
                   fmt: str = "dd.MM.yy") -> DataFrame:
    """IO2: the week date parsed from each row's source file name."""
    name = F.col("_metadata.file_path")
    return df.withColumn(col, F.try_to_date(F.regexp_extract(name, pattern, 1), fmt))


def read_weekly_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """IO2-IO4: one scan over a directory of per-week files, the week from the file name; unreadable files are skipped."""
    df = (spark.read.schema(schema).option("header", True).option("recursiveFileLookup", "true")
          .option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).csv(path))
    return with_file_week(df)


def write_weekly_files(df: DataFrame, date_col: str, path: str, mode: str = "append") -> None:
    """IO7/IO8: one folder per week named with its ``dd.MM.yy`` date (appendable)."""
    (df.withColumn("week_file", F.date_format(date_col, "dd.MM.yy"))
       .write.mode(mode).partitionBy("week_file").option("header", True).csv(path))


def write_single_csv(df: DataFrame, path: str) -> None:
    """IO7 / IO9 report sink: one CSV file, only for small outputs (reports)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
