"""Boosted trees from level codes equal Spark ML's on one-hot columns; rows lie in blocks while they grow."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tillroll.operators import boosting as B
from tillroll.operators import features as FE
from tillroll.operators import models as M

CATS, NUMS = ["c", "d"], ["x", "z"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(700):
        c, d, x, z = f"c{rng.integers(6)}", f"d{rng.integers(2)}", float(np.round(rng.normal(), 2)), float(rng.integers(3))
        y = (c == "c1") * 1.5 - (d == "d1") * x + 0.3 * z + float(rng.normal(0, 0.3))
        rows.append((i, c, d, x, z, y, float(y > 0.4)))
    return spark.createDataFrame(rows, "k long, c string, d string, x double, z double, y double, label double").repartition(3).cache()


def by_key(pred):
    return {r.k: r.prediction for r in pred.select("k", "prediction").collect()}


def spark_fit(train, est, test):
    pre = FE.one_hot_pipeline(CATS, NUMS).fit(train)
    return by_key(est.fit(pre.transform(train)).transform(pre.transform(test)))


@pytest.mark.parametrize("kind,of", [(GBTClassifier, {"maxIter": 4}), (GBTClassifier, {"maxIter": 3, "maxDepth": 3, "minInstancesPerNode": 25, "stepSize": 0.4}),
                                     (GBTRegressor, {"labelCol": "y", "maxIter": 4, "maxDepth": 4, "minWeightFractionPerNode": 0.08})])
def test_fits_equal_spark_ml(frame, kind, of, monkeypatch):
    est = kind(seed=42, **of)
    train, test = frame.where("k % 4 != 0 and c <> 'c5'"), frame.where("k % 4 = 0")  # a level that training rows do not have
    want = spark_fit(train, est, test)
    monkeypatch.setattr(type(est), "fit", lambda *a: pytest.fail("one-hot rows are read at every level"))
    got = by_key(M.fit_pipeline(train, est, CATS, NUMS).transform(test))
    assert got.keys() == want.keys() and len({round(v, 9) for v in got.values()}) > 1
    assert np.allclose([got[k] for k in want], [want[k] for k in want], atol=1e-5)


def test_columns_drawn_for_a_node(frame):
    est = GBTRegressor(labelCol="y", maxIter=3, maxDepth=3, featureSubsetStrategy="0.3", seed=42)
    fitted = B.fit(frame, est, CATS, NUMS)
    assert fitted.settings.node_columns == 5  # 6 + 2 levels, two columns of unknown levels each, two numbers: 14 columns
    again = B.fit(frame.repartition(5), est, CATS, NUMS)
    assert [[x.tolist() for x in t[:5]] for t in fitted.trees] == [[x.tolist() for x in t[:5]] for t in again.trees]
    whole = M.fit_pipeline(frame, est.copy({est.featureSubsetStrategy: "all"}), CATS, NUMS)
    err = [
        f.transform(frame).agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).head()[0] for f in (fitted, whole)]
    assert [x[0].tolist() for x in whole.trees] != [x[0].tolist() for x in fitted.trees] and err[1] < err[0] < 0.9


def test_class_search_equals_spark_ml(frame, monkeypatch):
    est = GBTClassifier(maxIter=3, seed=42)
    points = [{est.maxDepth: 2, est.minWeightFractionPerNode: 0.2}, {est.maxDepth: 5, est.stepSize: 0.3, est.minWeightFractionPerNode: 0.05},
              {est.maxDepth: 3, est.minWeightFractionPerNode: 0.49}]
    monkeypatch.setattr(M, "one_hot_pipeline", lambda: FE.one_hot_pipeline(CATS, NUMS))
    want = M.cross_validate(frame, est, points, ["k"], folds=3, classification=True).avgMetrics
    levels, sums = [], B.Batch._sums
    monkeypatch.setattr(B.Batch, "_sums", lambda *a: levels.append(1) or sums(*a))
    got = B.class_search(frame, [est.copy(p) for p in points], ["k"], 3, CATS, NUMS)
    assert np.allclose(got, want, atol=1e-4) and len(set(got)) == 3
    assert len(levels) <= 3 * 5  # scans: trees x levels of the deepest, whatever the candidates and folds


def test_rows_drawn_for_a_tree_count_towards_all_rows(frame):
    """The least leaf weight is a share of all rows: half of a sample of a third is never a leaf."""
    est = GBTClassifier(maxIter=2, subsamplingRate=0.3, minWeightFractionPerNode=0.2, seed=42)
    assert B.class_search(frame, [est], ["k"], 3, CATS, NUMS) == [0.5]


def test_rows_lie_in_blocks_and_only_drawn_rows_are_looked_up(frame, monkeypatch):
    data = B.binned(frame, CATS, NUMS, "y", ["k"], folds=3, max_bins=8)
    fit = B.Batch(data, [B.Boost(depth=3, trees=2, rows=0.3, fold=1)]).fit()
    blocks = fit._blocks.collect()
    assert sum(r.size for r in blocks) == 700 and len(blocks) <= data.rows.rdd.getNumPartitions()
    run, seen, nodes = [], [], B.nodes_of
    monkeypatch.setattr(fit, "state", type("Rows", (), {"mapInArrow": lambda self, f, schema: run.append(f)})())
    monkeypatch.setattr(B, "nodes_of", lambda tree, bins, rows=None: seen.append(len(bins) if rows is None else len(rows)) or nodes(tree, bins, rows))
    fit._sums(0, {0: B.Tree()}, 0)
    list(run[0](iter(fit._blocks.toArrow().to_batches())))
    assert seen and max(seen) < 0.5 * 700


def test_areas_by_hand(spark):
    points = spark.createDataFrame([(0, 0.9, 2, 0), (0, 0.5, 1, 1), (0, 0.5, 0, 1), (0, 0.1, 1, 2), (1, 0.3, 0, 4), (2, 0.3, 4, 0)],
                                   "model int, score double, ones long, zeros long")
    got = {r.model: r.area for r in B.areas(points, ["model"]).collect()}
    assert got == {0: (2 * (2 + 0.5) + 2 * (3 + 0.5)) / 16, 1: 0.0, 2: 1.0}
