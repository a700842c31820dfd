"""Operator 10: embedding near-duplicates by an exact metric range join.

Vectors are scaled to unit length, where cosine >= c is distance <= r = sqrt(2 - 2c).
Per label, pivots (its vectors of least hash, one for every cell of rows) part the
space: a vector is at home in the cell of its nearest pivot. A pair over two cells is found in the lower one, to which the other
vector is copied unless the triangle inequality shows that nothing there can be
within r:

* the cell reaches no further than ``reach`` from its pivot, so a vector beyond
  ``reach + r`` of it has no partner there;
* a segment from a home cell into another crosses the bisector of the two
  pivots, so a vector further than r from that bisector has no partner beyond.

Cells are joined on their own, in blocks of bounded size, and only sums leave a
block: links counted per vector, and a spanning forest of the block's links.

Where vectors cluster, cells are tight and copies few. Where they lie
about evenly in many dimensions every vector is near every bisector, and no exact
method in this metric prunes much: the work then nears all pairs of a label, as
matrix products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table
from .components import connected_components

BLOCK_ROWS = 2_048
CELL_ROWS = 1_024
MOST_PIVOTS = 64
SLACK = 1e-9
_TILE = 512


def unit(values) -> bytes | None:
    """The vector at unit length as doubles; None if it is null or zero or has null or non-finite parts."""
    if values is None or len(values) == 0:
        return None
    x = np.asarray(values, dtype=np.float64)  # a null part becomes NaN
    top = np.abs(x).max()
    if not np.isfinite(x).all() or top == 0:
        return None
    x = x / top
    return (x / math.sqrt(float(x @ x))).tobytes()


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = pd.DataFrame({"id": rows["id"], "label": rows["label"], "v": [unit(v) for v in rows["v"]]})
        yield out[out["v"].notna()]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def _pivot_matrix(rows: pd.DataFrame) -> np.ndarray:
    return _matrix(rows.sort_values("h")["v"])


def _homes(vectors: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    if vectors.empty:
        return pd.DataFrame()
    d = _distances(_matrix(vectors["v"]), _pivot_matrix(pivots))
    home = d.argmin(axis=1)
    return vectors[["rep", "label", "dim", "salt", "copies", "v"]].assign(
        home=home.astype(np.int32), away=d[np.arange(len(d)), home])


def _dealer(r: float):
    def deal(vectors: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        """The home row and the copies of each vector; ``pivots`` also has each cell's reach."""
        if vectors.empty:
            return pd.DataFrame()
        p = _pivot_matrix(pivots)
        reach = pivots.sort_values("h")["reach"].to_numpy()
        d = _distances(_matrix(vectors["v"]), p)
        home = vectors["home"].to_numpy()
        own = d[np.arange(len(d)), home][:, None]
        apart = _distances(p, p)[home]
        with np.errstate(divide="ignore", invalid="ignore"):
            bisector = (d * d - own * own) / (2.0 * apart)
        may = (d <= reach[None, :] + r) & ~(bisector > r) & (np.arange(len(p))[None, :] < home[:, None])
        at, cell = np.nonzero(may)
        out = pd.concat([vectors.assign(cell=home), vectors.iloc[at].assign(cell=cell.astype(np.int32))])
        return out[["rep", "label", "dim", "cell", "home", "copies", "v"]]
    return deal


def _union(parent: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The forest ``parent`` (all nodes point to their roots) with the links p - q added."""
    while True:
        p, q = parent[p], parent[q]
        apart = p != q
        if not apart.any():
            return parent
        p, q = p[apart], q[apart]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _joiner(cosine: float):
    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Each vector's links between two blocks of a cell (or within one), and the root that stands for them."""
        same = key[-2] == key[-1]
        left, right = rows[rows["side"] == 0], rows[rows["side"] == (0 if same else 1)]
        if left.empty or right.empty:
            return pd.DataFrame()
        x, y = _matrix(left["v"]), _matrix(right["v"])
        ids = left["rep"].to_numpy() if same else np.concatenate([left["rep"], right["rep"]])
        copies = left["copies"].to_numpy() if same else np.concatenate([left["copies"], right["copies"]])
        first = 0 if same else len(x)
        links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i in range(0, len(x), _TILE):
            for j in range(i if same else 0, len(y), _TILE):
                hit = x[i:i + _TILE] @ y[j:j + _TILE].T >= cosine
                if same and i == j:
                    hit = np.triu(hit, 1)
                p, q = np.nonzero(hit)
                p, q = p + i, q + j + first
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                parent = _union(parent, p, q)
        out = pd.DataFrame({"rep": ids, "links": links, "least": ids[parent]})
        return out[out["links"] > 0]
    return join


def range_join(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
               cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Links join vectors of equal, non-null label and equal length whose cosine, in
    double precision, is at least ``cosine`` (0 < cosine < 1). Vectors that are null, empty, zero or
    hold null or non-finite parts link with nothing and are components of their
    own. Equal vectors of a label are one node that counts each of its rows; rows
    that repeat an id are counted as rows and share the id's component. A null
    id is returned with a null component. An empty table gives no rows; other columns are
    not read.
    """
    r = math.sqrt(2.0 - 2.0 * cosine) + SLACK
    rows = vectors.select(vectors[vec_id].cast("long").alias("id"), vectors[label].alias("label"),
                          vectors[embedding].cast("array<double>").alias("v"))
    kind = rows.schema["label"].dataType.simpleString()
    units = checkpointed(rows.where("id is not null and label is not null").mapInPandas(
        _units, f"id long, label {kind}, v binary"), "units")
    nodes = checkpointed(
        units.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        .withColumn("dim", F.octet_length("v")).withColumn("h", F.xxhash64("v")), "nodes")
    labels = checkpointed(nodes.groupBy("label", "dim").agg(F.count("*").alias("n"), F.min("h").alias("first")).select(
        "label", "dim", "first", F.greatest(F.lit(1), F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("n") / CELL_ROWS))).alias("p"),
        F.ceil(F.col("n") / BLOCK_ROWS).alias("salts"), F.col("n")), "labels")
    # a label's pivots are its rows of least hash, picked among the few whose hash lies in the lowest share
    share = F.col("p") * 4.0 / F.col("n") + 20.0 / F.col("n")
    low = nodes.join(labels, ["label", "dim"]).where(
        (F.shiftrightunsigned("h", 33) <= F.least(F.lit(1.0), share) * F.lit(float(2 ** 31))) | (F.col("h") == F.col("first")))
    by_hash = F.sort_array(F.collect_list(F.struct("h", "rep", "v")))
    pivots = (low.groupBy("label", "dim").agg(by_hash.alias("all"), F.max("p").alias("p"), F.max("salts").alias("salts"))
              .select("label", "dim", "salts", F.posexplode(F.slice("all", F.lit(1), F.col("p").cast("int"))).alias("h", "x"))
              .select("label", "dim", "salts", F.col("h"), F.col("x.v").alias("v"), F.lit(0.0).alias("reach")))
    pivots = checkpointed(pivots, "pivots")
    per_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
    salted = pivots.withColumn("salt", per_block).drop("salts")
    group = ["label", "dim", "salt"]
    vec = f"rep long, label {kind}, dim int"
    dealt = (nodes.join(labels.select("label", "dim", "salts"), ["label", "dim"])
             .withColumn("salt", F.pmod(F.col("h"), F.col("salts"))).drop("salts", "h"))
    homes = checkpointed(dealt.groupBy(*group).cogroup(salted.groupBy(*group)).applyInPandas(
        _homes, f"{vec}, salt long, copies long, v binary, home int, away double"), "homes")
    reach = homes.groupBy("label", "dim", F.col("home").alias("h")).agg(F.max("away").alias("far"), F.count("*").alias("n"))
    reaching = (salted.join(reach, ["label", "dim", "h"], "left")
                .withColumn("reach", F.coalesce(F.col("far") + SLACK, F.lit(-10.0))).drop("far", "n"))
    cells = checkpointed(homes.groupBy(*group).cogroup(reaching.groupBy(*group)).applyInPandas(
        _dealer(r), f"{vec}, cell int, home int, copies long, v binary"), "cells")
    # blocks of a cell: its own vectors in `own` blocks, its copies from other cells in `more` blocks
    at_home = F.col("cell") == F.col("home")
    block_of = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK_ROWS)).cast("int")
    sizes = cells.groupBy("label", "dim", "cell").agg(
        block_of(F.count(F.when(at_home, 1))).alias("own"), F.ceil(F.count(F.when(~at_home, 1)) / BLOCK_ROWS).cast("int").alias("more"))
    hashed = F.xxhash64("rep")
    placed = (cells.join(sizes, ["label", "dim", "cell"]).withColumn("home_row", at_home)
              .withColumn("block", F.when(at_home, F.pmod(hashed, F.col("own")))
                          .otherwise(F.col("own") + F.pmod(hashed, F.greatest(F.col("more"), F.lit(1)))).cast("int")))
    everywhere = F.sequence(F.lit(0), F.col("own") + F.col("more") - 1)
    as_left = placed.where("home_row").select("*", F.explode(F.filter(everywhere, lambda j: j >= F.col("block"))).alias("j"))
    own_blocks = F.sequence(F.lit(0), F.col("own") - 1)
    as_right = placed.select("*", F.explode(F.filter(own_blocks, lambda i: i < F.col("block"))).alias("i"))
    pairs = (as_left.select("label", "dim", "cell", F.col("block").alias("i"), "j", F.lit(0).alias("side"), "rep", "copies", "v")
             .unionByName(as_right.select("label", "dim", "cell", "i", F.col("block").alias("j"), F.lit(1).alias("side"),
                                          "rep", "copies", "v")))
    found = checkpointed(pairs.groupBy("label", "dim", "cell", "i", "j").applyInPandas(
        _joiner(cosine), "rep long, links long, least long"), "links")
    groups = connected_components(found.where("rep <> least"), "rep", "least")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_node = (nodes.select("label", "v", "rep", "copies").join(counts, "rep", "left")
               .join(groups, F.col("rep") == F.col("vertex"), "left")
               .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       F.coalesce("component", "rep").alias("component_id")))
    linked = (units.join(of_node, ["label", "v"])
              .groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")))
    out = rows.select("id").join(linked, "id", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings"), cosine=0.93)


def oracle_sql() -> dict[str, str]:
    """All pairs of a label, and reachability by recursion: for small tables only."""
    return {"op10_metric_range_join": """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null),
ok as (select * from v where list_count(e) = len(e) and isfinite(list_sum(e)) and list_dot_product(e, e) > 0),
link as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id
         and list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join link l on l.a = r.b)
select e.vec_id, (select count(*) from link l where l.a = e.vec_id) as n_links,
       r.component_id, e.vec_id = r.component_id as kept
from embeddings e join (select a, min(b) as component_id from reach group by a) r on r.a = e.vec_id"""}
