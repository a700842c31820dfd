"""DQ1: near-duplicate category levels (e.g. 'stainless steel' vs 'stainles steel').

For every distinct lower-cased level of an attribute, the up-to-``top`` other
levels of the same attribute whose Levenshtein similarity
``1 - d / max(len_a, len_b)`` is at least ``threshold``.

Candidate pairs come from an exact prefix-filtered similarity join instead of
comparing every pair: a level is a multiset of characters, tokenised as
``char#occurrence``. An edit changes at most one shared token, so a pair that
qualifies shares at least ``ceil(threshold * max_len)`` tokens; under one
global token order (rarest first) two sets with that overlap must share a
token among their first ``len - ceil(threshold * len) + 1`` tokens. Only
those prefix tokens are joined (an equi-join on (feature, token)); every
candidate is then verified with the exact distance.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_levels(df: DataFrame, attrs: list[str]) -> DataFrame:
    parts = None
    for a in attrs:
        p = (df.where(F.col(a).isNotNull())
               .select(F.lit(a).alias("feature"), F.lower(F.col(a).cast("string")).alias("level")))
        parts = p if parts is None else parts.unionByName(p)
    return parts.distinct()


def fuzzy_level_matches(df: DataFrame, attrs: list[str], threshold: float = 0.6, top: int = 3) -> DataFrame:
    lv = distinct_levels(df, attrs).withColumn("len", F.length("level")).where(F.col("len") > 0)
    ch = lv.select("feature", "level", "len",
                   F.posexplode(F.split("level", "")).alias("pos", "c"))
    occ = F.row_number().over(Window.partitionBy("feature", "level", "c").orderBy("pos"))
    tok = ch.withColumn("token", F.concat_ws("#", "c", occ.cast("string"))).select("feature", "level", "len", "token")
    # global rarest-first order per feature; the token vocabulary is
    # alphabet x max repeats, so this window is small
    freq = tok.groupBy("feature", "token").agg(F.count("*").alias("f"))
    order = freq.withColumn("grank", F.row_number().over(Window.partitionBy("feature").orderBy("f", "token")))
    ranked = tok.join(order.select("feature", "token", "grank"), ["feature", "token"])
    k = F.row_number().over(Window.partitionBy("feature", "level").orderBy("grank"))
    prefix_len = F.col("len") - F.ceil(F.col("len") * F.lit(threshold)) + 1
    prefix = ranked.withColumn("k", k).where(F.col("k") <= prefix_len).select("feature", "level", "token")
    a = prefix.alias("a")
    b = prefix.alias("b")
    cand = (a.join(b, (F.col("a.feature") == F.col("b.feature")) & (F.col("a.token") == F.col("b.token"))
                   & (F.col("a.level") != F.col("b.level")))
             .select(F.col("a.feature").alias("feature"), F.col("a.level").alias("level"),
                     F.col("b.level").alias("match"))
             .distinct())
    sim = F.lit(1.0) - F.levenshtein("level", "match").cast("double") / \
        F.greatest(F.length("level"), F.length("match")).cast("double")
    scored = cand.withColumn("similarity", sim).where(F.col("similarity") >= threshold)
    rk = F.row_number().over(Window.partitionBy("feature", "level").orderBy(F.desc("similarity"), "match"))
    return scored.withColumn("match_rank", rk).where(F.col("match_rank") <= top)


def min_shared_tokens(len_a: int, len_b: int, threshold: float) -> int:
    """Lower bound on shared character tokens of a qualifying pair (for tests)."""
    return math.ceil(threshold * max(len_a, len_b))
