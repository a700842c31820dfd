"""Connected components of an edge list, as a fixed number of shuffles a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, component): the smallest vertex reachable, for every vertex of ``edges``.

    Alternates large-star and small-star steps until the edges stop changing;
    both only move an edge end to a smaller neighbour, so what is left are
    stars around the smallest vertex of each component. Minima are combined
    before the shuffle, the joins are plain equi-joins that AQE may split where
    a vertex has very many edges, and every round is written to the shared
    checkpoint folder. Null ends and loops are ignored; repeated edges and
    either direction are fine; no edges give no rows.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where("u is not null and v is not null and u <> v").distinct())
    e = checkpointed(e, "edges")
    before, now = None, _state(e)
    while now != before and now[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = checkpointed(small, "edges")
        before, now = now, _state(e)
    roots = e.select(F.col("v").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
