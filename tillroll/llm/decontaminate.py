"""Operator 3: benchmark decontamination by spaced-seed hashing. DataFrame functions only.

Texts become words (lower case, runs of letters and digits). A spaced seed is a fixed mask
over neighbouring words: its hash takes the words under a 1 and ignores those under a 0, so
that a changed word under a 0 doesn't hide the passage. The masks are lossless for
the overlap that counts: whatever 2 words of a window of 13 are replaced, one mask lies
somewhere in the window with all of its 1s on unchanged words.

Seeds of the benchmark's items are joined with the seeds of all training
texts. At each hit the words around it are compared place by place, and the hit counts
if a window of 13 words over it agrees in 11 (a share of 0.8 or more); places before or
behind the text count as changed. Items of
fewer than 13 words but at least 5 must occur whole and unchanged.

Training texts are not shuffled: the benchmark's seeds go to the tasks as broadcast
blocks of at most ``BLOCK`` seeds each (a larger benchmark makes more blocks and
scans), and a hit takes along the few words around it that are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, free_name, table

WINDOW = 13
AGREE = 11
SHORTEST = 5
MASKS = ("110101111", "1110011011", "100111100011")
BLOCK = 200_000
CHUNK = 256


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null and empty texts have none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def _seed(tokens: str, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(F.col(tokens), at + i) for i, x in enumerate(mask) if x == "1"])


def _seeds(df: DataFrame, masks: list[str]) -> DataFrame:
    """``df`` without ``tokens``, once for every word and mask that begins there: ``seed``, ``span``, ``at``.

    Rows carry no more than a chunk of the text: ``part`` is the chunk with ``WINDOW``
    words on either side, and the seed begins ``at`` words into it, ``first + at`` words into the
    text. A mask that runs over the end makes no row.
    """
    shortest = min(map(len, masks))
    keep = [c for c in df.columns if c != "tokens"]
    n = F.size("tokens")
    starts = F.when(n >= shortest, F.sequence(F.lit(0), n - shortest, F.lit(CHUNK)))
    first = F.greatest(F.col("chunk") - WINDOW, F.lit(0))
    parts = df.select(*keep, "tokens", F.explode(starts).alias("chunk")).select(
        *keep, first.alias("first"), (F.col("chunk") - first).alias("lead"),
        F.slice("tokens", first + 1, F.lit(CHUNK + 2 * WINDOW)).alias("part"))
    last = F.least(F.col("lead") + CHUNK - 1, F.size("part") - shortest)
    places = F.when(last >= F.col("lead"), F.sequence("lead", last))
    seeds = F.array(*[F.struct(F.lit(len(m)).alias("span"),
                               F.when(F.col("at") + len(m) <= F.size("part"), _seed("part", F.col("at"), m)).alias("seed"))
                      for m in masks])
    return (parts.select(*keep, "first", "part", F.explode(places).alias("at"))
            .select(*keep, "first", "part", "at", F.inline(seeds)).where("seed is not null"))


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, back, around, window, need): the seeds of all items with the words to compare around them.

    ``items``: (item, tokens), distinct in tokens. ``around`` begins ``back`` words
    before the seed; ``need`` is how many words of a window must agree.
    """
    start = F.greatest(F.lit(0), F.col("at") + F.col("span") - WINDOW)
    stop = F.least(F.size("part"), F.col("at") + WINDOW)
    return _seeds(items.where(F.size("tokens") >= WINDOW), list(MASKS)).select(
        "seed", "item", (F.col("at") - start).alias("back"), F.slice("part", start + 1, stop - start).alias("around"),
        F.lit(WINDOW).alias("window"), F.lit(AGREE).alias("need"))


def _short_seeds(items: DataFrame, length: int) -> DataFrame:
    one = items.where(F.size("tokens") == length)
    return one.select(_seed("tokens", F.lit(0), "1" * length).alias("seed"), "item", F.lit(0).alias("back"),
                      F.col("tokens").alias("around"), F.lit(length).alias("window"), F.lit(length).alias("need"))


def _best_window(agrees: str, window: Column) -> Column:
    """The most agreeing words in any ``window`` neighbouring places of the array of 0s and 1s."""
    last = F.greatest(F.lit(0), F.size(agrees) - window)
    sums = F.transform(F.sequence(F.lit(0), last), lambda i: F.aggregate(
        F.slice(F.col(agrees), i + 1, window), F.lit(0), lambda a, b: a + b))
    return F.array_max(sums)


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
             item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, hits, agreeing, first_word, last_word): contaminated documents and what they hold.

    One row for each document and distinct benchmark text that overlap: ``hits``
    seeds were verified, the best window has ``agreeing`` equal words, and the hits
    lie on the words ``first_word`` to ``last_word`` of the document (from 0).
    ``item_id`` is the smallest id of the items with that text (ids of null rank
    last). Null, empty and short texts and items overlap with nothing; repeated
    document rows count as one, by id; either table may be empty. Other columns are not
    read.
    """
    items = benchmark.select(benchmark[item_id].alias("id"), words(benchmark[item_text]).alias("tokens"))
    items = checkpointed(items.where(F.size("tokens") >= SHORTEST).groupBy("tokens").agg(F.min("id").alias("item")),
                         "benchmark")
    lengths = sorted(r[0] for r in items.select(F.size("tokens")).where(F.size("tokens") < WINDOW).distinct().collect())
    seeds = benchmark_seeds(items)
    for n in lengths:
        seeds = seeds.unionByName(_short_seeds(items, n))
    masks = list(MASKS) + ["1" * n for n in lengths]
    seeds = checkpointed(seeds, "benchmark-seeds")
    blocks = max(1, -(-seeds.count() // BLOCK))
    tokens = docs.select(docs[doc_id].alias("doc"), words(docs[text]).alias("tokens"))
    found = None
    for b in range(blocks):
        part = seeds if blocks == 1 else seeds.where(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == b)
        begin = F.col("at") - F.col("back")
        here = F.slice("part", F.greatest(F.lit(0), begin) + 1, F.size("around"))
        there = F.when(begin < 0, F.slice("around", 1 - begin, F.size("around"))).otherwise(F.col("around"))
        # written out, so that the comparison stays out of the join, whose generated code holds one chunk at a time
        hits = checkpointed(_seeds(tokens, masks).join(F.broadcast(part), "seed").select(
            "doc", "item", (F.col("first") + F.col("at")).alias("at"), "span", "window", "need", here.alias("here"),
            there.alias("there")), "hits")
        agrees = F.zip_with("here", "there", lambda p, q: F.when(p == q, 1).otherwise(0))
        good = (hits.withColumn("agrees", agrees)
                .select("doc", "item", "at", "span", "need", _best_window("agrees", F.col("window")).alias("best"))
                .where("best >= need"))
        one = good.groupBy("doc", "item").agg(
            F.count("*").alias("hits"), F.max("best").alias("agreeing"), F.min("at").alias("first_word"),
            F.max(F.col("at") + F.col("span") - 1).alias("last_word"))
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        found = found.groupBy("doc", "item").agg(
            F.sum("hits").alias("hits"), F.max("agreeing").alias("agreeing"), F.min("first_word").alias("first_word"),
            F.max("last_word").alias("last_word"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "hits", "agreeing", "first_word",
                        "last_word")


def clean_documents(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents; a document of null id goes if any of null id is contaminated."""
    key = free_name(docs, "contaminated")
    bad = checkpointed(overlaps(docs, benchmark, doc_id, text).select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return docs.join(bad, docs[doc_id].eqNullSafe(bad[key]), "left_anti")


def op3_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle_sql() -> dict[str, str]:
    """The seeds of all texts as words, joined, and every window around a hit counted out."""
    masks = [(m, WINDOW, AGREE, f">= {WINDOW}") for m in MASKS] + [("1" * n, n, n, f"= {n}") for n in range(SHORTEST, WINDOW)]

    def seeds(table: str, key: str, every: bool) -> str:
        parts = []
        for number, (m, window, need, size) in enumerate(masks):
            word = ", ".join(f"t[pos + {i + 1}]" for i, x in enumerate(m) if x == "1")
            parts.append(f"select {key}, t, pos, {number} as mask, {len(m)} as span, {window} as win, {need} as need, "
                         f"concat_ws(' ', {word}) as seed from (select {key}, t, unnest(range(0, len(t) - {len(m) - 1})) as pos "
                         f"from {table} where len(t) {size if every else '>= ' + str(len(m))})")
        return " union all ".join(parts)

    return {"op3_spaced_seed_decontamination": rf"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') as t from documents),
i as (select min(item_id) as item_id, t from (
        select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') as t from benchmark)
      where len(t) >= {SHORTEST} group by t),
ds as ({seeds("d", "doc_id", False)}),
bs as ({seeds("i", "item_id", True)}),
hit as (
  select row_number() over () as hit, ds.doc_id, bs.item_id, ds.t as dt, bs.t as bt, ds.pos, bs.span, bs.win, bs.need,
         ds.pos - bs.pos as off, greatest(0, bs.pos + bs.span - bs.win, bs.pos - ds.pos) as lo, least(len(bs.t), bs.pos + bs.win) as hi
  from ds join bs using (mask, seed)),
place as (
  select *, case when j + off >= 0 and j + off < len(dt) and dt[j + off + 1] = bt[j + 1] then 1 else 0 end as same
  from (select *, unnest(range(lo, hi)) as j from hit)),
run as (
  select hit, j, hi, lo, win, sum(same) over (partition by hit order by j rows between current row and 12 following) as long_,
         sum(same) over (partition by hit) as all_
  from place),
best as (select hit, max(case when win = {WINDOW} and j <= greatest(lo, hi - win) then long_ when win < {WINDOW} then all_ end) as best
         from run group by hit)
select doc_id, item_id, count(*) as hits, cast(max(best) as integer) as agreeing, cast(min(pos) as integer) as first_word,
       cast(max(pos + span - 1) as integer) as last_word
from hit join best using (hit) where best >= need group by doc_id, item_id"""}
