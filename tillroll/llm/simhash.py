"""Operator 5: SimHash near-duplicates by pivot distance tables.

Every text gets a 64-bit fingerprint. Distinct fingerprints (copies are never
expanded) get a *pivot table*: their Hamming distances to many reference
fingerprints. By the triangle inequality two fingerprints within ``max_bits``
bits differ by no more than that in any coordinate of the table.

Distances to random references crowd around half the bits and would keep nearly
every pair, so the references are a base and its *flips* (the base with two
neighbouring bits turned over; 32 of them) and a set of random ones. A flip
lies two bits from the base, and half the difference of the two distances is the
distance to the base on those two bits alone. Each changed bit moves one
such coordinate, so close fingerprints agree in all but ``max_bits`` of them: cut
into ``m`` bands, at least ``m - max_bits`` bands agree in full. Every choice of
``m - max_bits`` bands is a cell key, and fingerprints are joined on equal cells
only. Of the pairs in a cell those beyond ``max_bits`` in any coordinate of the
table are discarded, and the survivors are verified by their exact distance.
Nothing close is lost and no pair outside a cell is formed.
"""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, free_name, table, utf8, with_values
from .components import connected_components

CHUNK = 1 << 17
BITS = 64
FLIPS = BITS // 2
_LANES = np.arange(8, dtype=np.int64) * 256
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint as a signed 64-bit number.

    Words are runs of non-white-space, A-Z lower-cased. The XXH64 (seed 42) of
    every shingle votes on each bit; a bit is set by more than half the votes.
    Fewer words than ``width`` form one shingle; no word (or null) gives zero.
    The votes of a long text are counted in chunks of bounded size.
    """
    words = utf8(text).lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n]
    ends = ends[-n:]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros((8, 256), dtype=np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[s:e], 42) for s, e in
                      zip(starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist())], dtype=np.uint64)
        lanes = h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8) + _LANES
        votes += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256)
    ones = (votes @ _BYTE_BITS).ravel() * 2 > n
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, into: str = "fingerprint") -> DataFrame:
    """``docs`` without ``text`` and with the signed fingerprint ``into``; other columns are kept."""
    return with_values(docs, text, lambda texts: [fingerprint(t, width) for t in texts], into, T.LongType(), keep_text=False)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Pivots:
    """The base, its two-bit flips and the random references, from one seed."""

    def __init__(self, random_refs: int = 16, seed: int = 42):
        rng = random.Random(seed)
        self.base = rng.getrandbits(BITS)
        self.refs = [self.base, *(self.base ^ (3 << (2 * i)) for i in range(FLIPS)),
                     *(rng.getrandbits(BITS) for _ in range(random_refs))]

    def distances(self, fp: Column) -> Column:
        """The pivot table of a fingerprint: array of its distances to all references."""
        return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(r)))).cast("tinyint") for r in self.refs])

    @staticmethod
    def coordinate(distances: str, i: int) -> Column:
        """The distance to the base on the two bits of flip ``i``: 0, 1 or 2."""
        d = F.col(distances)
        return F.floor((d[0] - d[i + 1] + 2) / 2).cast("long")


def bands_for(n: int, max_bits: int) -> int:
    """The fewest bands whose cells, by the entropy of their coordinates, hold about one of ``n``."""
    need = math.log2(max(n, 2))
    for m in range(max_bits + 2, 2 * max_bits + 9):
        if 1.5 * FLIPS * (m - max_bits) / m >= need:
            return m
    return 2 * max_bits + 8


def close_pairs(prints: DataFrame, fp: str, max_bits: int = 3, pivots: Pivots | None = None,
                bands: int | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of distinct values of ``prints[fp]`` within ``max_bits`` bits.

    ``bands`` only sets how the work is cut, never the result; by default it
    follows from the number of distinct fingerprints.
    """
    pivots = pivots or Pivots()
    distinct = checkpointed(prints.select(F.col(fp).alias("fp")).where("fp is not null").distinct(), "fingerprints")
    m = bands or bands_for(distinct.count(), max_bits)
    edges = [round(FLIPS * i / m) for i in range(m + 1)]
    tables = distinct.select("fp", pivots.distances(F.col("fp")).alias("d"))
    band = [sum((Pivots.coordinate("d", i) * 3 ** (i - lo) for i in range(lo, hi)), F.lit(0).cast("long"))
            for lo, hi in zip(edges, edges[1:])]
    tables = tables.select("fp", "d", *[x.alias(f"band{i}") for i, x in enumerate(band)])
    cells = F.explode(F.array(*[
        F.struct(F.lit(t).alias("choice"), F.xxhash64(*[f"band{i}" for i in kept]).alias("cell"))
        for t, kept in enumerate(itertools.combinations(range(m), max(1, m - max_bits)))]))
    dealt = tables.select("fp", "d", cells.alias("c")).select("fp", "d", "c.choice", "c.cell")
    x, y = dealt.alias("x"), dealt.alias("y")
    spread = F.array_max(F.zip_with("x.d", "y.d", lambda p, q: F.abs(p - q)))
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_bits
    return (x.join(y, (F.col("x.choice") == F.col("y.choice")) & (F.col("x.cell") == F.col("y.cell"))
                   & (F.col("x.fp") < F.col("y.fp")) & (spread <= max_bits) & near)
            .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3,
                    max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    ``fingerprint`` is signed; ``component_id`` is the smallest id reachable over
    links of ``max_bits`` bits or fewer, the row's own included. Equal
    fingerprints are one node of the graph, so a third of all rows being copies
    costs one row a task. Null and empty texts have the fingerprint zero and link
    like any other; null ids take part and are passed over by the minimum (a
    group of null ids alone has a null component); repeated rows are all
    returned; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    prints = checkpointed(fingerprints(rows, width=width), "doc-fingerprints")
    firsts = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    groups = connected_components(close_pairs(prints, "fingerprint", max_bits), "a", "b")
    named = (firsts.join(groups, firsts["fingerprint"] == groups["vertex"], "left")
             .select("fingerprint", F.coalesce("component", "fingerprint").alias("component"), "first"))
    named = checkpointed(named, "named-fingerprints")
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    members = named.join(least, "component").select("fingerprint", "component_id")
    return prints.join(members, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3,
             max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id.

    Rows that share that id are ranked by their text's hash and the first is
    kept. Null ids rank last. All columns are kept as they are.
    """
    tie_of = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    marked = checkpointed(fingerprints(docs.select(docs[doc_id].alias("doc_id"), tie_of.alias("tie"),
                                                   docs[text].alias("text")), width=width), "stage-fingerprints")
    groups = connected_components(close_pairs(marked, "fingerprint", max_bits), "a", "b")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    first = marked.groupBy("fingerprint").agg(F.min(rank).alias("best"))
    best = (first.join(groups, first["fingerprint"] == groups["vertex"], "left")
            .groupBy(F.coalesce("component", "fingerprint").alias("component")).agg(F.min("best").alias("best"))
            .select("best.doc_id", "best.tie"))
    times = marked.groupBy("doc_id", "tie").agg(F.count("*").alias("rows"))
    key, tie, rows = (free_name(docs, x) for x in ("simhash_id", "simhash_tie", "simhash_rows"))
    best = checkpointed(best.join(times, best["doc_id"].eqNullSafe(times["doc_id"]) & (best["tie"] == times["tie"]))
                        .select(best["doc_id"].alias(key), best["tie"].alias(tie), F.col("rows").alias(rows)),
                        "stage-kept")

    def stay(wanted: DataFrame) -> DataFrame:
        return docs.join(wanted, docs[doc_id].eqNullSafe(wanted[key]) & (tie_of == wanted[tie]))

    once = stay(best.where(F.col(rows) == 1)).select(*docs.columns)
    again = stay(best.where(F.col(rows) > 1)).dropDuplicates([key, tie]).select(*docs.columns)
    return once.unionByName(again)


def op5_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
