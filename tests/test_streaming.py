"""The weekly stock stream resumes from its checkpoint without duplicating output."""

from pyspark.sql import functions as F

from tillroll.sources.files import shared_scratch, write_weekly_files
from tillroll.sources.testdata import RetailTables
from tillroll.streaming.weekly_files import stream_weekly_stock


def test_restart_is_idempotent_and_picks_up_new_weeks(spark, sf):
    raw = RetailTables(spark, sf).closing_stock_raw.where(F.col("closing_date").isNotNull())
    weeks = sorted(r[0] for r in raw.select("closing_date").distinct().collect())
    first, later = weeks[: len(weeks) // 2], weeks[len(weeks) // 2:]
    base = shared_scratch(spark, "stream-test")
    src, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/_ckpt"
    write_weekly_files(raw.where(F.col("closing_date").isin(first)), "closing_date", src)
    stream_weekly_stock(spark, src, out, ckpt)
    n1 = spark.read.parquet(out).count()
    stream_weekly_stock(spark, src, out, ckpt)          # restart: nothing new, nothing duplicated
    assert spark.read.parquet(out).count() == n1
    write_weekly_files(raw.where(F.col("closing_date").isin(later)), "closing_date", src)
    stream_weekly_stock(spark, src, out, ckpt)          # new week folders arrive
    got = spark.read.parquet(out).drop("file_week")
    from tillroll.operators.facts import closing_stock
    exp = closing_stock(raw)
    assert got.count() == exp.count()
    assert got.select(*exp.columns).exceptAll(exp).count() == 0


def test_weeks_split_over_batches_are_summarised_once(spark, sf):
    raw = RetailTables(spark, sf).closing_stock_raw.where(F.col("closing_date").isNotNull())
    weeks = sorted(r[0] for r in raw.select("closing_date").distinct().collect())[:3]
    some = raw.where(F.col("closing_date").isin(weeks))
    base = shared_scratch(spark, "stream-test")
    src, out, ckpt = f"{base}/in", f"{base}/out", f"{base}/_ckpt"
    for _ in range(2):
        write_weekly_files(some.repartition(4), "closing_date", src)  # up to eight files a week
    stream_weekly_stock(spark, src, out, ckpt, files_per_batch=2)
    from tillroll.operators.facts import closing_stock
    exp = closing_stock(some.unionByName(some))
    got = spark.read.parquet(out).select(*exp.columns)
    assert got.count() == exp.count() and got.exceptAll(exp).count() == 0


def test_unreadable_week_file_is_skipped(spark, tmp_path):
    from tillroll.sources.files import CLOSING_STOCK_SCHEMA, read_weekly_files
    head = ",".join(CLOSING_STOCK_SCHEMA.names)
    (tmp_path / "stock 05.05.19.csv").write_text(f"{head}\n" + "," * (len(CLOSING_STOCK_SCHEMA.names) - 1) + "\n")
    (tmp_path / "stock 12.05.19.csv.gz").write_bytes(b"this is no gzip file")
    got = read_weekly_files(spark, str(tmp_path), CLOSING_STOCK_SCHEMA).select("file_week").collect()
    assert [str(r.file_week) for r in got] == ["2019-05-05"]
