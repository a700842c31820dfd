"""Operator 4: k-d tree sharding at distributed weighted medians. DataFrame functions only.

Documents are points in metadata space (source, language, length, ...). A node that is to
become ``k`` shards is split along its widest dimension where ``k // 2`` of
its ``k`` parts of the bytes lie below - the weighted median for an even ``k`` - until every leaf is
one shard of the target bytes. All nodes of a level are split together: one
grouped pass gives their extents, and the medians come from key histograms
(``radix.weighted_cuts``), so neither a node nor a hot source is ever sorted or
gathered.

Points are ordered within a dimension by coordinate, then by their number in the
order of text CRC (equal texts lie together), size, id and metadata. Every row has
a number of its own, so a value, an id or a whole row that a third of all rows
share is cut at the right byte too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, free_name, numbered, table
from .radix import weighted_cuts

ROWS_PER_BLOCK = 2_000
METADATA = (("source", "category"), ("lang", "category"), ("n_chars", "number"))


def coordinate(df: DataFrame, name: str, kind: str) -> Column:
    """A dimension as a 31-bit number: 0 for null; categories by their hash; numbers clipped to 0 .. 2^31 - 2, plus 1."""
    if kind == "category":
        return F.when(df[name].isNull(), 0).otherwise(F.pmod(F.crc32(df[name].cast("string").cast("binary")),
                                                             F.lit(2 ** 31 - 2)) + 1).cast("long")
    number = F.least(F.greatest(df[name].cast("double"), F.lit(0.0)), F.lit(float(2 ** 31 - 3)))
    return F.when(df[name].isNull() | F.isnan(number), 0).otherwise(number.cast("long") + 1).cast("long")


def _points(docs: DataFrame, doc_id: str, text: str, metadata, row: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, x0, x1, ..., tie), and the column ``row`` as ``row``.

    ``tie`` is the row's number in the order of all but ``row``, scaled to 32 bits: numbers differ among up to 2^32
    rows, and beyond that a few neighbours share one. Equal rows are told apart by their place in the written
    table, so they are spread over the ranges of the sort however many they are.
    """
    body = F.coalesce(docs[text], F.lit(""))
    axes = [f"x{i}" for i in range(len(metadata))]
    points = docs.select(docs[doc_id].alias("doc_id"), (F.octet_length(body) + F.lit(16)).cast("long").alias("size"),
                         F.crc32(body.cast("binary")).alias("text_crc32"),
                         *[coordinate(docs, c, kind).alias(x) for x, (c, kind) in zip(axes, metadata)],
                         *([docs[row].alias("row")] if row else []), F.monotonically_increasing_id().alias("place"))
    points = checkpointed(points, "points")
    rows = points.count()
    number = numbered(points, ["text_crc32", "size", "doc_id", *axes, "place"], "number")
    wide = max(1, -(-rows // 2 ** 32))
    return number.withColumn("tie", F.expr(f"number div {wide}")).drop("number", "place")


def _widest(stats: DataFrame, ranges: list[int]) -> Column:
    wide = [(F.col(f"hi{i}") - F.col(f"lo{i}")).cast("double") / F.lit(float(max(r, 1))) for i, r in enumerate(ranges)]
    most = F.greatest(*wide) if len(wide) > 1 else wide[0]
    return F.coalesce(*[F.when(w == most, i) for i, w in enumerate(wide)])


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, doc_id: str = "doc_id",
              text: str = "text", metadata=METADATA, row: str | None = None) -> DataFrame:
    """One row per row of ``docs``: (doc_id, size, text_crc32, shard, slot), and the column ``row`` as ``row`` if given.

    Give the number of ``shards``, or ``target_bytes`` a shard (then there are
    as many as the total needs). ``size`` is the text's UTF-8 bytes plus 16 (null
    text: 16, CRC of nothing), shards are numbered from 0 in tree order and
    ``slot`` is gapless from 0 in each. Metadata columns that ``docs`` lacks are
    no dimensions; null metadata lie below all values. Repeated rows, and rows
    that share an id or have none, are points of their own, each with its place in the order: a
    shard ends between any two rows, and of equal rows as many go to a shard on
    every run. An empty table gives no rows; with fewer rows than
    shards some shards stay empty. Other columns are not read.
    """
    metadata = [(c, k) for c, k in metadata if c in docs.columns] or [(doc_id, "category")]
    # the node is written too: joined as a literal it would make a nested loop
    base = checkpointed(_points(docs, doc_id, text, metadata, row).withColumn("lo", F.lit(0).cast("long")), "ordered")
    own = ["row"] if row else []
    total, rows = base.agg(F.sum("size"), F.count("*")).first()
    if not rows:
        return base.select("doc_id", "size", "text_crc32", *own, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    k = shards or -(-total // target_bytes)
    base = base.withColumn("k", F.lit(k).cast("long"))
    ends = [e for i in range(len(metadata)) for e in (F.min(f"x{i}").alias(f"lo{i}"), F.max(f"x{i}").alias(f"hi{i}"))]
    ranges, parts = None, k
    while parts > 1:
        stats = base.where("k > 1").groupBy("lo", "k").agg(F.sum("size").alias("total"), *ends)
        if ranges is None:
            whole = stats.first()
            ranges = [whole[f"hi{i}"] - whole[f"lo{i}"] for i in range(len(metadata))]
        left = F.expr("k div 2")
        nodes = checkpointed(stats.select(
            "lo", left.alias("kl"), _widest(stats, ranges).alias("dim"),
            F.expr("(total div k) * (k div 2) + ((total % k) * (k div 2)) div k").alias("target")), "nodes")
        placed = base.join(nodes.select("lo", "kl", "dim"), "lo", "left")
        along = F.coalesce(*[F.when(F.col("dim") == i, F.col(f"x{i}")) for i in range(len(metadata))])
        placed = checkpointed(placed.withColumn("key", F.shiftleft(along, 32) + F.col("tie")), "placed")
        cuts = weighted_cuts(placed.where("dim is not null"), nodes, ["lo"], F.col("key"), F.col("size"), 3)
        nearer = F.col("target") - F.col("below") > F.col("below") + F.col("at") - F.col("target")
        cuts = cuts.join(nodes.select("lo", "target"), "lo").select("lo", (F.col("cut") + F.when(
            nearer & (F.col("at") > 0), 1).otherwise(0)).alias("cut"))
        goes_left = F.col("key") < F.col("cut")
        base = (placed.join(cuts, "lo", "left")
                .withColumns({"lo": F.when(F.col("dim").isNull() | goes_left, F.col("lo")).otherwise(F.col("lo") + F.col("kl")),
                              "k": F.when(F.col("dim").isNull(), F.col("k")).when(goes_left, F.col("kl"))
                              .otherwise(F.col("k") - F.col("kl"))})
                .drop("kl", "dim", "key", "cut"))
        parts = -(-parts // 2)
    blocks = max(1, -(-rows // (k * ROWS_PER_BLOCK)))
    placed = base.select("doc_id", "size", "text_crc32", *own, F.col("lo").cast("int").alias("shard"), "tie",
                         F.pmod(F.xxhash64("tie"), F.lit(blocks)).alias("block"))
    placed = checkpointed(placed, "shards")
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("tie", "doc_id"))
    return (placed.withColumn("at", within).join(offsets, ["shard", "block"])
            .select("doc_id", "size", "text_crc32", *own, "shard", (F.col("from") + F.col("at") - 1).alias("slot")))


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """The rows of ``docs`` as one Parquet folder per shard; ``how`` as for ``kd_shards``.

    Rows are numbered in a written copy and matched by that number, so copies of one row go where their own places are.
    """
    row, shard = free_name(docs, "kd_row"), free_name(docs, "shard")
    fixed = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()), "to-shard")
    where = kd_shards(fixed, row=row, **how).select(F.col("row").alias(row), F.col("shard").alias(shard))
    fixed.join(where, row).drop(row).write.partitionBy(shard).parquet(path)


def op4_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
