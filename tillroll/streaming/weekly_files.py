"""Weekly stock files arriving one or more per week, summarised as they land (IO2 + IO8).

A file-source ``readStream`` over the week folders (the week comes from the
file path), ``availableNow`` trigger, and ``foreachBatch``. A micro-batch may hold
some of a week's files only, so it just names the weeks that changed: each of them is
summarised again from all its files and replaces its partition of the output.
The result does not depend on how files fall into batches, and a retried batch
writes the same partitions again. Offsets and progress live in a checkpoint location under the
shared checkpoint directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facts import closing_stock
from ..sources.files import CLOSING_STOCK_SCHEMA, shared_scratch, with_file_week, write_weekly_files


def stream_weekly_stock(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                        files_per_batch: int = 200) -> None:
    stream = (spark.readStream.schema(CLOSING_STOCK_SCHEMA).option("header", True)
              .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
              .csv(source_dir))
    stream = with_file_week(stream)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # at most one week per file of the batch
        weeks = [r.file_week for r in batch.select("file_week").where("file_week is not null").distinct().collect()]
        if not weeks:
            return
        whole = (batch.sparkSession.read.schema(CLOSING_STOCK_SCHEMA).option("header", True)
                 .option("recursiveFileLookup", "true").csv([f"{source_dir}/*{w:%d.%m.%y}*" for w in weeks]))
        rows = with_file_week(whole).withColumn("closing_date", F.coalesce("closing_date", "file_week"))
        (closing_stock(rows, extra_keys=("file_week",)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("file_week").parquet(out_dir))

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def weekly_stock_via_stream(spark: SparkSession, closing_stock_raw: DataFrame) -> DataFrame:
    """Write the stock rows as one folder per week, stream them back, and
    return the streamed summary table."""
    base = shared_scratch(spark, "weekly-stock")
    src, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/_checkpoint"
    rows = closing_stock_raw.where(F.col("closing_date").isNotNull())
    write_weekly_files(rows, "closing_date", src)
    stream_weekly_stock(spark, src, out, ckpt)
    return spark.read.parquet(out).drop("file_week")
