"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back."""
    return materialize(df, f"llm-{name}")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_of_id(doc_id: Column) -> Column:
    """CRC-32 of an id written as text (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def utf8(text: str | None) -> bytes:
    """The text's UTF-8 bytes; lone surrogates, which Spark cannot hold, are replaced."""
    return (text or "").encode("utf-8", "replace")


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """``df`` with the gapless numbers 0, 1, ... in ascending ``order`` (nulls first).

    A range sort with offsets: each range is numbered on its own, and the sizes
    of the ranges (one row each) are summed up to offsets. No task gets all rows.
    """
    part = F.spark_partition_id().alias("_range")
    ranged = checkpointed(df.repartitionByRange(*order).select("*", part), "ranges")
    sums = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (ranged.withColumn("_at", within).join(offsets, "_range")
            .select(*df.columns, (F.col("_from") + F.col("_at") - 1).alias(into)))


def with_values(docs: DataFrame, text: str, f, into: str, kind: T.DataType, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``into``: ``f`` of every text, in Python. ``f`` takes a list of texts (or nulls) and gives a list."""
    keep = [c for c in docs.columns if c != into and (keep_text or c != text)]
    at = len(keep)
    names = [f"c{i}" for i in range(at)] + ["value"]
    plain = docs.select(*[docs[c] for c in keep], docs[text]).toDF(*names)
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(f(batch.column(at).to_pylist()), type=arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], values], names=names)

    schema = T.StructType([*plain.schema.fields[:at], T.StructField("value", kind)])
    return plain.mapInArrow(run, schema).toDF(*keep, into)
