import math

import numpy as np
import pytest

from tillroll.llm import metric_join
from tillroll.llm.metric_join import range_join

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, cosine=0.93):
    ok = {}
    for i, e, label, *_ in rows:
        x = None if e is None else np.array([math.nan if v is None else v for v in e], float)
        if label is not None and x is not None and len(x) and np.isfinite(x).all() and x.any():
            ok[i] = (label, x / np.linalg.norm(x))
    ids = [r[0] for r in rows]
    near = {i: {j for j in ok if i != j and i in ok and ok[i][0] == ok[j][0] and len(ok[i][1]) == len(ok[j][1])
                and ok[i][1] @ ok[j][1] >= cosine} for i in ids}
    group = {}
    for i in sorted(ids):
        todo = [] if i in group else [i]
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = i
                todo += near[x]
    return {i: (len(near[i]), group[i], group[i] == i) for i in ids}


def clouds(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = np.where(rng.random((n, 1)) < 0.5, rng.normal(size=(n, dim)), centres[rng.integers(0, 12, n)] + 0.2 * rng.normal(size=(n, dim)))
    x[n // 2] = x[n // 3]
    return [(int(i), [float(np.float32(v)) for v in row], int(i % 3), "x") for i, row in enumerate(x)]


@pytest.mark.parametrize("cell,block,dim", [(30, 40, 6), (10_000, 25, 6), (25, 10_000, 3)])
def test_against_brute_force(spark, monkeypatch, cell, block, dim):
    monkeypatch.setattr(metric_join, "CELL_ROWS", cell)
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", block)
    rows = clouds(400, dim, seed=dim + cell)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in range_join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_test_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in range_join(df).collect()}
    assert got == brute([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1, "x"), (2, [2.0, 0.0], 1, "x"), (3, [1.0, 0.01], 1, None), (4, [1.0, 0.0], None, "x"),
            (5, None, 1, "x"), (6, [], 1, "x"), (7, [0.0, 0.0], 1, "x"), (8, [nan, 1.0], 1, "x"), (9, [inf, 1.0], 1, "x"),
            (10, [None, 1.0], 1, "x"), (11, [1.0, 0.0], 2, "x"), (12, [1.0, 0.0, 0.0], 1, "x"), (13, [1e-30, 0.0], 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in range_join(df).collect()}
    assert got == brute(rows) and got[13][1] == 1 and got[3][0] == 3
    with_null = df.unionByName(spark.createDataFrame([(None, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x")], SCHEMA))
    again = range_join(with_null).collect()
    assert len(again) == 15 and [(r.n_links, r.component_id, r.kept) for r in again if r.vec_id is None] == [(0, None, False)]
    assert range_join(df.where("false")).count() == 0
