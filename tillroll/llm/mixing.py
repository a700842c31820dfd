"""Operator 6: mixing sources to target weights by capped water-filling.

Targets are shares of a word budget in proportion to the sources' weights. Sources whose share
exceeds ``max_epochs`` times their size are clamped there, and the excess is
shared among the others in proportion until none is above its cap: each step is one
distributed sum over the sources that gives a new water level.

A source is repeated whole as often as its target allows. The rest is a seeded
sample: documents in the order of a hash of their id (where an id repeats, of id, text and the number of
the copy, so every row has a place of its own), taken as long as they fit. Where
the next one does not fit, further passes go on behind it with the documents that
still do, so that the words taken come near the target even where a few
documents hold most words. The order is never sorted out: the pass ends are
weighted cuts of the hash (``radix.weighted_cuts``), and whether a row is taken follows
from its hash, its size and its source's row in the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, free_name, numbered, table
from .radix import weighted_cuts

FILL_PASSES = 4


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash42(doc_id: Column, copy: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), copy).cast("binary"))
    return F.shiftright(F.conv(F.substring(digest, 1, 11), 16, 10).cast("long"), 2)


def with_copy(docs: DataFrame, doc_id: str, text: str, source: str, into: str) -> DataFrame:
    """``docs`` with ``into``: what tells rows of one id (or of none) apart, empty for an id of one row.

    It holds the text's MD5 and the row's number among the rows equal in id, text and source. Only rows of
    repeated ids are written (equal rows differ by their place in that table alone); the ids are counted first, so where none
    repeats nothing is written or shuffled but they. Copies are numbered per part of the table, and the parts' counts,
    one row a part, are summed up to offsets: a group of a third of all rows is no task's own.
    """
    known = F.coalesce(docs[doc_id].cast("string"), F.lit(""))
    i, p, h, r = (free_name(docs, x) for x in ("mix_id", "mix_part", "mix_digest", "mix_row"))
    own = docs.withColumn(i, known)
    twice = checkpointed(docs.select(known.alias(i)).groupBy(i).count().where("count > 1").select(i), "repeated-ids")
    once = own.join(twice, i, "left_anti").select(*docs.columns, F.lit("").alias(into))
    digest = F.md5(F.coalesce(docs[text], F.lit("")).cast("binary"))
    again = checkpointed(own.join(twice, i, "left_semi").withColumns(
        {h: digest, p: F.spark_partition_id(), r: F.monotonically_increasing_id()}), "repeated-rows")
    same = [i, h, free_name(docs, "mix_of")]
    rows = again.select(p, r, i, h, F.to_json(F.struct(again[source])).alias(same[2]))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(p, *same).orderBy(r)))
    parts = rows.groupBy(p, *same).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*same).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    number = rows.join(parts, [p, *same]).select(r, F.concat(F.lit(":"), h, F.lit(":"), F.col("_from") + F.col("_at") - 1).alias(into))
    return once.unionByName(again.join(number, r).select(*docs.columns, into))


def water_level(sources: DataFrame, budget: float, max_epochs: float) -> float | None:
    """The words a unit of weight gets; None if every source is at its cap.

    ``sources``: (size, weight). Clamped sources stay clamped, for the level
    only rises, so the loop ends after as many steps as clamp another source.
    """
    level, clamped = 0.0, -1
    cap = F.col("size") * F.lit(float(max_epochs))
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        now, capped, weight = sources.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
                                          F.sum(F.when(~full, F.col("weight")))).first()
        if not weight:
            return None
        if now == clamped:
            return level
        level, clamped = (budget - capped) / weight, now


def mixing_plan(rows: DataFrame, weights: DataFrame, fraction: float, max_epochs: float) -> DataFrame:
    """One row per source: its size, target, whole repetitions and the passes of its sample.

    ``rows``: (none, src, size, key); ``weights``: (none, src, weight).
    """
    group = ["none", "src"]
    sizes = rows.groupBy(*group).agg(F.sum("size").alias("size"))
    sources = checkpointed(sizes.join(weights, group, "left").withColumn(
        "weight", F.coalesce("weight", F.lit(0)).cast("double")), "sources")
    budget = float(fraction) * (sources.agg(F.sum("size")).first()[0] or 0)
    level = water_level(sources, budget, max_epochs)
    cap = F.col("size") * F.lit(float(max_epochs))
    target = cap if level is None else F.least(F.col("weight") * F.lit(level), cap)
    whole = F.when(F.col("size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("size"))).cast("long")
    plan = (sources.withColumn("target", target).withColumn("whole", whole)
            .withColumn("gap0", F.floor(F.col("target") - F.col("whole") * F.col("size")).cast("long"))
            .withColumn("cut0", F.lit(0).cast("long")))
    for p in range(1, FILL_PASSES + 1):
        plan = checkpointed(plan, "mixing-plan")
        fit = rows if p == 1 else (rows.join(plan.select(*group, f"cut{p - 1}", f"gap{p - 1}"), group)
                                   .where((F.col("key") >= F.col(f"cut{p - 1}"))
                                          & (F.col("size") <= F.col(f"gap{p - 1}"))))
        cuts = weighted_cuts(fit, plan.select(*group, F.col(f"gap{p - 1}").alias("target")), group,
                             F.col("key"), F.col("size"), 2)
        plan = (plan.join(cuts.drop("at"), group, "left")
                .withColumn(f"cut{p}", F.col("cut")).withColumn(f"gap{p}", F.col(f"gap{p - 1}") - F.col("below"))
                .drop("cut", "below"))
    return checkpointed(plan, "mixing-plan")


def mix(docs: DataFrame, weights: DataFrame, fraction: float = 1.5, max_epochs: float = 2.0, seed: int = 42,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with ``mix_size, mix_source_size, mix_target, mix_copies`` (words, words, words, times taken).

    ``weights``: (source, weight), one row per source, null being a source of its
    own; a source without a row weighs nothing. The budget is ``fraction`` of all
    words; sizes count runs of non-white-space (null: 0). A source of no words
    has the target 0, and its documents are taken 0 times or as often as whole.
    Rows that share an id or have none are taken one by one; of equal rows as many are taken on every run.
    An empty table gives no rows. Clashing names in ``docs`` get their underscores on the new columns.
    """
    copy = free_name(docs, "mix_copy")
    each = with_copy(docs, doc_id, text, source, copy)
    none, src = each[source].isNull(), F.coalesce(each[source], F.lit(""))
    size, key = words_in(each[text]), hash42(each[doc_id], each[copy], seed)
    rows = checkpointed(each.select(none.alias("none"), src.alias("src"), size.alias("size"), key.alias("key")), "mixing")
    wanted = weights.select(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("src"), "weight")
    plan = mixing_plan(rows, wanted, fraction, max_epochs)
    s, k, n, c = (free_name(docs, x) for x in ("mix_size", "mix_key", "mix_none", "mix_src"))
    total, target, copies, how = (free_name(docs, x) for x in ("mix_source_size", "mix_target", "mix_copies", "mix_plan"))
    per_source = plan.select(F.col("none").alias(n), F.col("src").alias(c), F.col("size").alias(total),
                             F.col("target").alias(target), F.struct("whole", *[f"cut{p}" for p in range(1, FILL_PASSES + 1)],
                                                                    *[f"gap{p}" for p in range(1, FILL_PASSES)]).alias(how))
    own = each.withColumns({n: none, c: src, s: size, k: key})
    joined = own.join(per_source, [n, c])
    taken = F.col(k) < F.col(f"{how}.cut1")
    for p in range(2, FILL_PASSES + 1):
        taken = taken | ((F.col(k) >= F.col(f"{how}.cut{p - 1}")) & (F.col(k) < F.col(f"{how}.cut{p}"))
                         & (F.col(s) <= F.col(f"{how}.gap{p - 1}")))
    times = (F.col(f"{how}.whole") + F.when(taken & (F.col(s) > 0), 1).otherwise(0)).cast("long")
    return joined.select(*docs.columns, s, total, target, times.alias(copies))


def mixed_documents(docs: DataFrame, weights: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it."""
    counted = mix(docs, weights, **how)
    copies = counted.columns[-1]
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    return counted.where(F.col(copies) > 0).withColumn(copies, again).select(*docs.columns)


def repeating_weights(docs: DataFrame, source: str = "source", cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, weight): the sources in code-point order, null last, weigh ``cycle`` again and again."""
    sources = docs.select(docs[source].alias("source")).distinct().withColumn("none", F.col("source").isNull())
    ranked = numbered(sources, ["none", "source"], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))
    return checkpointed(ranked.select("source", weight.alias("weight")), "weights")


def op6_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs, repeating_weights(docs), fraction=1.5, max_epochs=2.0, seed=42)
    return mixed.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def oracle_sql() -> dict[str, str]:
    """Targets from the sources in the order in which they reach their caps; the sample by running sums."""
    passes, plan = [], "targets"
    for p in range(1, FILL_PASSES + 1):
        last = f"cut{p - 1}, gap{p - 1}"
        passes.append(f"""
run{p} as (
  select d.none, d.src, d.key, d.size, {last},
         sum(d.size) over (partition by d.none, d.src order by d.key range unbounded preceding) as upto
  from doc d join {plan} t using (none, src) where d.key >= cut{p - 1} and (d.size <= gap{p - 1} or {p} = 1)),
end{p} as (select none, src, min(key) as cut{p} from run{p} where upto > gap{p - 1} group by none, src),
plan{p} as (
  select t.*, coalesce(e.cut{p}, {2 ** 63 - 1}) as cut{p}, t.gap{p - 1} - coalesce((
           select sum(size) from run{p} r where r.none = t.none and r.src = t.src
           and (e.cut{p} is null or r.key < e.cut{p})), 0) as gap{p}
  from {plan} t left join end{p} e using (none, src))""")
        plan = f"plan{p}"
    taken = " or ".join(["key < cut1"] + [f"(key >= cut{p - 1} and key < cut{p} and d.size <= gap{p - 1})"
                                          for p in range(2, FILL_PASSES + 1)])
    return {"op6_water_filling_mix": rf"""
with doc as (
  select doc_id, source is null as none, coalesce(source, '') as src,
         cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size,
         cast('0x' || substr(md5('42:' || coalesce(cast(doc_id as varchar), '') || case when same_id > 1
                then ':' || md5(coalesce(text, '')) || ':' || copy else '' end), 1, 11) as bigint) // 4 as key
  from (select doc_id, source, text, count(*) over (partition by coalesce(cast(doc_id as varchar), '')) as same_id,
               row_number() over (partition by coalesce(cast(doc_id as varchar), ''), md5(coalesce(text, '')), source) - 1 as copy
        from documents)),
source_size as (select none, src, cast(sum(size) as bigint) as total from doc group by none, src),
weighed as (
  select *, cast([5, 2, 1][(row_number() over (order by none, src) - 1) % 3 + 1] as double) as w, total * 2.0::double as cap
  from source_size),
filling as (
  select *, w * (((select sum(total) from source_size) * 1.5::double
                  - coalesce(sum(cap) over (order by cap / w, none, src rows between unbounded preceding and 1 preceding), 0))
                 / sum(w) over (order by cap / w, none, src rows between current row and unbounded following)) >= cap as full_,
         ((select sum(total) from source_size) * 1.5::double
                  - coalesce(sum(cap) over (order by cap / w, none, src rows between unbounded preceding and 1 preceding), 0))
                 / sum(w) over (order by cap / w, none, src rows between current row and unbounded following) as level
  from weighed),
level as (select min_by(level, cap / w) as level from filling where not full_),
reached as (select none, src, total, least(w * coalesce((select level from level), 1e300), cap) as target from weighed),
targets as (
  select *, 0::bigint as cut0, cast(floor(target - whole * total) as bigint) as gap0
  from (select *, case when total = 0 then 0 else cast(floor(target / total) as bigint) end as whole from reached)),{",".join(passes)}
select d.doc_id, d.size, t.total as source_size, t.target,
       d.size * (t.whole + case when d.size > 0 and ({taken}) then 1 else 0 end) as taken
from doc d join {plan} t using (none, src)"""}
