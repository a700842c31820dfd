"""ML16: k-prototypes clustering of mixed numeric / categorical rows.

Distance = squared Euclidean on the numeric columns + ``gamma`` x number of
categorical mismatches. Each iteration: the k prototypes (k rows) are
broadcast, every row is assigned to its nearest prototype with a column
expression, and new prototypes are one ``groupBy(cluster)`` (mean of numbers,
mode of categories). Initial prototypes follow a density-based seeding in
the spirit of the Cao method: the first is the row whose category values
are most frequent overall; each next one maximises density x distance to the
chosen ones, found by a distributed argmax over all rows. The loop
checkpoints every few iterations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _distance(num_cols, cat_cols, proto: dict, gamma: float):
    d = F.lit(0.0)
    for c in num_cols:
        d = d + (F.col(c) - F.lit(float(proto[c]))) ** 2
    for c in cat_cols:
        d = d + F.when(F.col(c) == F.lit(proto[c]), F.lit(0.0)).otherwise(F.lit(float(gamma)))
    return d


def _density(df: DataFrame, cat_cols: list[str]) -> DataFrame:
    """Sum over categorical columns of the relative frequency of the row's value."""
    n = df.count()
    out = df
    dens = F.lit(0.0)
    for c in cat_cols:
        f = df.groupBy(c).agg((F.count("*") / F.lit(float(n))).alias(f"_f_{c}"))
        out = out.join(f, c, "left")
        dens = dens + F.coalesce(F.col(f"_f_{c}"), F.lit(0.0))
    return out.withColumn("_density", dens).drop(*[f"_f_{c}" for c in cat_cols])


def kprototypes(df: DataFrame, num_cols: list[str], cat_cols: list[str], k: int = 15, gamma: float | None = None,
                iterations: int = 10, checkpoint_every: int = 3) -> tuple[DataFrame, list]:
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    base = df.select(*num_cols, *cat_cols).na.fill(0.0, num_cols).na.fill("nan", cat_cols)
    if gamma is None:
        sd = base.agg(*[F.stddev(c).alias(c) for c in num_cols]).head()
        gamma = 0.5 * (sum(float(sd[c] or 0.0) for c in num_cols) / max(len(num_cols), 1))
    dens = _density(base, cat_cols)
    if checkpoint_every:
        dens = dens.checkpoint(eager=True)
    order = [*num_cols, *cat_cols]
    # density-based seeding over all rows: each next prototype is the row with
    # the largest density x distance to the chosen ones (a distributed argmax)
    protos = [dens.orderBy(F.desc("_density"), *order).limit(1).collect()[0].asDict()]
    while len(protos) < k:
        dmin = F.least(*[_distance(num_cols, cat_cols, p, gamma) for p in protos]) if len(protos) > 1 \
            else _distance(num_cols, cat_cols, protos[0], gamma)
        best = dens.withColumn("_score", F.col("_density") * dmin).orderBy(F.desc("_score"), *order).limit(1).collect()
        if not best or best[0]["_score"] <= 0:
            break
        protos.append(best[0].asDict())
    cur = base
    for it in range(iterations):
        dists = [F.struct(_distance(num_cols, cat_cols, p, gamma).alias("d"), F.lit(i).alias("c"))
                 for i, p in enumerate(protos)]
        cur = base.withColumn("cluster", F.array_min(F.array(*dists))["c"])
        if (it + 1) % checkpoint_every == 0:
            cur = cur.checkpoint(eager=True)
        new = (cur.groupBy("cluster")
                  .agg(*[F.avg(c).alias(c) for c in num_cols],
                       *[F.mode(F.col(c), deterministic=True).alias(c) for c in cat_cols])
                  .orderBy("cluster").collect())
        updated = {r["cluster"]: r.asDict() for r in new}
        nxt = [updated.get(i, p) for i, p in enumerate(protos)]
        if all(all(nxt[i][c] == protos[i][c] for c in num_cols + cat_cols) for i in range(len(protos))):
            protos = nxt
            break
        protos = nxt
    dists = [F.struct(_distance(num_cols, cat_cols, p, gamma).alias("d"), F.lit(i).alias("c"))
             for i, p in enumerate(protos)]
    return df.withColumn("cluster", F.array_min(F.array(*dists))["c"]), protos
