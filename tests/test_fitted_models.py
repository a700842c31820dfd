"""Linear discriminants against numpy; fits that iterate read their source once."""

import numpy as np
from pyspark.ml.linalg import Vectors

from tillroll.operators import models as M


def rows_of(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"]).repartition(3)


def test_linear_discriminants_against_numpy(spark):
    rng = np.random.default_rng(7)
    y = np.repeat([0, 1, 3], [60, 90, 50])
    x = rng.normal(size=(200, 4)) @ np.diag([1.0, 5.0, 0.2, 300.0]) + y[:, None] * np.array([0.8, 1.0, 0.1, 50.0]) + 1000.0
    classes, coefs, icpt = M.lda_fit(rows_of(spark, x, y), shrink=0.0)
    pooled = sum((x[y == c] - x[y == c].mean(0)).T @ (x[y == c] - x[y == c].mean(0)) for c in (0, 1, 3)) / (200 - 3)
    want = np.stack([(x - x.mean(0)) @ np.linalg.solve(pooled, x[y == c].mean(0) - x.mean(0))
                     - 0.5 * (x[y == c].mean(0) - x.mean(0)) @ np.linalg.solve(pooled, x[y == c].mean(0) - x.mean(0))
                     + np.log(np.mean(y == c)) for c in (0, 1, 3)], axis=1)
    got = np.stack([x @ coefs[c] + icpt[c] for c in classes], axis=1)
    assert classes == [0, 1, 3] and np.allclose(got, want, atol=1e-6)
    pred = M.lda_predict(rows_of(spark, x, y), (classes, coefs, icpt)).collect()
    best = {tuple(a): (0, 1, 3)[i] for a, i in zip(x, want.argmax(1))}
    assert all(r.prediction == best[tuple(r.features.toArray())] for r in pred)


def test_collinear_features_have_a_solution(spark):
    x = np.array([[1.0, 0.0, 5.0], [0.0, 1.0, 5.0], [1.0, 0.0, 5.0], [0.0, 1.0, 5.0]] * 5)
    y = np.array([0, 1, 0, 0] * 5)
    _, coefs, icpt = M.lda_fit(rows_of(spark, x, y))
    assert all(np.isfinite(c).all() for c in coefs.values()) and all(np.isfinite(v) for v in icpt.values())


def counted(spark, df, col):
    """``df`` with ``col`` through a function that counts its calls."""
    from pyspark.sql import functions as F
    calls = spark.sparkContext.accumulator(0)

    def seen(v):
        calls.add(1)
        return v
    return df.withColumn(col, F.udf(seen, df.schema[col].dataType).asNondeterministic()(col)), calls


def test_iterations_do_not_read_the_source_rows_again(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{rng.integers(3)}", float(rng.normal()), float(rng.poisson(1.5))) for _ in range(200)]
    df, calls = counted(spark, spark.createDataFrame(rows, "c string, x double, label double").repartition(2), "label")
    model = M.fit_pipeline(df, M.poisson_glm(), ["c"], ["x"])
    assert calls.value <= 400 and len(model.stages) == 4
    x = M.fit_pipeline(df.drop("label").withColumn("label", df["x"]), M.linear_regression(), ["c"], ["x"]).transform(df)
    assert all(abs(r.prediction - r.x) < 1e-6 for r in x.collect())


def test_rounds_of_the_zero_inflated_fit_do_not_read_the_source_rows_again(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    y = np.where(rng.random(300) < 0.4, 0, rng.poisson(np.exp(0.5 + 0.3 * x[:, 0])))
    df, calls = counted(spark, rows_of(spark, x, y), "label")
    logit, pois = M.zip_fit(df, iterations=3)
    assert calls.value <= 300
    # the rounds written out with numpy's weights, one Spark fit after the other
    pi = lambda: 1 / (1 + np.exp(-(x @ logit2.coefficients.toArray() + logit2.intercept)))
    w, logit2, pois2 = np.where(y == 0, 0.5, 0.0), None, None
    for _ in range(3):
        both = [(Vectors.dense(a), z, float(v)) for a, b in zip(x, w) for z, v in ((1.0, b), (0.0, 1 - b))]
        logit2 = M.LogisticRegression(labelCol="z", weightCol="w", maxIter=50).fit(spark.createDataFrame(both, ["features", "z", "w"]))
        own = [(Vectors.dense(a), float(b), float(1 - v)) for a, b, v in zip(x, y, w)]
        pois2 = M.GeneralizedLinearRegression(labelCol="y", weightCol="w", family="poisson", link="log", maxIter=25).fit(
            spark.createDataFrame(own, ["features", "y", "w"]))
        mu = np.exp(x @ pois2.coefficients.toArray() + pois2.intercept)
        w = np.where(y == 0, pi() / (pi() + (1 - pi()) * np.exp(-mu)), 0.0)
    assert np.allclose(pois.coefficients.toArray(), pois2.coefficients.toArray(), atol=1e-4)
    assert np.allclose(logit.coefficients.toArray(), logit2.coefficients.toArray(), atol=1e-2)
