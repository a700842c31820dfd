"""Spark ML models and evaluation (ML1-ML21).

Every model is a ``pyspark.ml`` estimator fitted on a distributed DataFrame;
metrics are single aggregations. Linear discriminant analysis (not in
``pyspark.ml``) is built from two distributed passes and a driver-side solve of
a d x d system; the zero-inflated Poisson model is an EM loop of weighted
Spark ML fits on rows that are kept meanwhile.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression, NaiveBayes,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import CAT_COLS, NUM_COLS, one_hot_pipeline


# -- estimators ---------------------------------------------------------------

def linear_regression(label: str = "label") -> LinearRegression:
    return LinearRegression(featuresCol="features", labelCol=label)


def logistic_regression(label: str = "label") -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol=label, maxIter=100)


def gbt_regressor(label: str = "label") -> GBTRegressor:
    """ML3, fixed settings: squared-error boosting of depth 5, step 0.1, 10 trees, feature fraction 0.3.

    Searches and the tuned settings are fitted by ``boosting.Batch``.
    """
    return GBTRegressor(featuresCol="features", labelCol=label, maxDepth=5, stepSize=0.1, maxIter=10,
                        featureSubsetStrategy="0.3", seed=42)


def gbt_classifier(label: str = "label") -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol=label, seed=42)


def decision_tree(label: str = "label", min_leaf: int = 100) -> DecisionTreeClassifier:
    """ML5: entropy criterion, at least ``min_leaf`` rows per leaf."""
    return DecisionTreeClassifier(featuresCol="features", labelCol=label, impurity="entropy",
                                  minInstancesPerNode=min_leaf, seed=42)


def random_forest(label: str = "label") -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=100, seed=42)


def naive_bayes(label: str = "label") -> NaiveBayes:
    """ML8: multinomial NB (features must be non-negative)."""
    return NaiveBayes(featuresCol="features", labelCol=label, modelType="multinomial")


def poisson_glm(label: str = "label") -> GeneralizedLinearRegression:
    """ML10: Poisson regression with log link."""
    return GeneralizedLinearRegression(featuresCol="features", labelCol=label, family="poisson", link="log",
                                       maxIter=25)


def fit_pipeline(train: DataFrame, estimator, cat_cols=None, num_cols=None):
    """One-hot stages and ``estimator``, fitted one after the other.

    Boosted trees that may split on all columns are fitted by ``boosting.fit`` (where columns are drawn for a node, only Spark ML
    draws Spark ML's): the same trees from level codes, a few bytes a row, where Spark ML keeps
    all one-hot columns of a row and reads them at every level. Spark ML reads its input once per iteration or level, so the encoded rows are kept for as long as the fit takes:
    without that every pass would index and encode all attributes anew. Partitions and row order stay those of ``train``.
    """
    if isinstance(estimator, GBTClassifier | GBTRegressor) and estimator.getFeatureSubsetStrategy() in ("all", "auto"):
        from . import boosting
        return boosting.fit(train, estimator, CAT_COLS if cat_cols is None else cat_cols, NUM_COLS if num_cols is None else num_cols)
    pre = one_hot_pipeline(cat_cols, num_cols).fit(train)
    rows = pre.transform(train).select("features", estimator.getLabelCol()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return PipelineModel(stages=pre.stages + [estimator.fit(rows)])
    finally:
        rows.unpersist()


# -- metrics --------------------------------------------------------------------

def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """ML17: RMSE and R² in one aggregation (R² = 1 - SSE / SST)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    one = pred.agg(F.count("*").alias("n"), F.sum((y - p) * (y - p)).alias("sse"), F.sum(y).alias("sy"),
                   F.sum(y * y).alias("syy"))
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return one.select("n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
                      (F.lit(1.0) - F.try_divide(F.col("sse"), sst)).alias("r2"))


def classification_rates(pred: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] | None = None,
                         rows: str | None = None) -> DataFrame:
    """ML18 + ML20: TN% and FP% of the negatives, FN% and TP% of the positives,
    accuracy, and the AUC of hard predictions ((TPR + TNR) / 2).

    With ``by``, of each group (its columns come last); ``rows`` is how many rows a row of ``pred`` stands for."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    n = F.col(rows) if rows else F.lit(1)
    own = lambda a, b: F.coalesce(F.sum(F.when((y == a) & (p == b), n)), F.lit(0)).cast("long")
    c = pred.groupBy(*(by or [])).agg(own(0, 0).alias("tn"), own(0, 1).alias("fp"), own(1, 0).alias("fn"), own(1, 1).alias("tp"))
    neg = (F.col("tn") + F.col("fp")).cast("double")
    pos = (F.col("fn") + F.col("tp")).cast("double")
    tnr = F.try_divide(F.col("tn").cast("double"), neg)
    tpr = F.try_divide(F.col("tp").cast("double"), pos)
    return c.select("tn", "fp", "fn", "tp",
                    (tnr * 100).alias("tn_pct"), (F.try_divide(F.col("fp").cast("double"), neg) * 100).alias("fp_pct"),
                    (F.try_divide(F.col("fn").cast("double"), pos) * 100).alias("fn_pct"), (tpr * 100).alias("tp_pct"),
                    F.try_divide((F.col("tn") + F.col("tp")).cast("double"), neg + pos).alias("accuracy"),
                    ((tpr + tnr) / 2).alias("auc_hard"), *(by or []))


def majority_baseline(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """ML12: predict the most frequent training class for every test row
    (the mode is one scalar from a single-row aggregate)."""
    mode = train.agg(F.mode(F.col(label), deterministic=True).alias("m")).head()["m"]
    return test.withColumn("prediction", F.lit(mode))


# -- search -----------------------------------------------------------------------

def random_points(grid: dict[str, list], n_iter: int, seed: int = 42) -> list[dict]:
    """ML13: ``n_iter`` distinct random points of a parameter grid (all of them where there are fewer)."""
    keys = sorted(grid)
    rng = random.Random(seed)
    points, seen = [], set()
    total = int(np.prod([len(grid[k]) for k in keys]))
    while len(points) < min(n_iter, total):
        pick = tuple(rng.randrange(len(grid[k])) for k in keys)
        if pick in seen:
            continue
        seen.add(pick)
        points.append({k: grid[k][i] for k, i in zip(keys, pick)})
    return points


def random_grid(grid: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """``random_points`` of a grid over an estimator's parameters."""
    of = {p.name: p for p in grid}
    return [{of[k]: v for k, v in x.items()} for x in random_points({p.name: v for p, v in grid.items()}, n_iter, seed)]


def cross_validate(train: DataFrame, estimator, param_maps: list[dict], keys: list[str], metric: str = "r2",
                   folds: int = 5, classification: bool = False, label: str = "label", parallelism: int = 8):
    """ML13-ML15: k-fold cross-validation over the given parameter maps.

    The one-hot stages do not depend on the candidates (nor on the label), so they are fitted once and
    their output is written once with a fold per row (from a hash of ``keys``); the candidates are fitted on
    that table, ``parallelism`` at a time.
    """
    from ..session import materialize
    pre = one_hot_pipeline().fit(train)
    fold = F.pmod(F.xxhash64(F.lit(7), *keys), F.lit(folds)).cast("int")
    table = materialize(pre.transform(train.withColumn("fold", fold)).select("features", label, "fold"), "cv")
    if classification:
        ev = BinaryClassificationEvaluator(labelCol=label, metricName="areaUnderROC")
    else:
        ev = RegressionEvaluator(labelCol=label, metricName=metric)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=param_maps or [{}], evaluator=ev, numFolds=folds,
                        foldCol="fold", parallelism=parallelism, seed=42)
    return cv.fit(table)


# -- linear discriminant analysis --------------------------------------------------

def lda_fit(train: DataFrame, label: str = "label", features: str = "features", shrink: float = 1e-6):
    """ML9: LDA with a pooled within-class covariance.

    Two distributed passes whatever the number of classes: counts and means of all classes, and the covariance of
    all rows (``RowMatrix``: blocks added up as a tree in the JVM). The within-class scatter is the total one less
    that of the class means. Only d x d numbers (d = features) reach the driver, which solves the system
    by Cholesky on standardised features with ``shrink`` on the diagonal (one-hot levels are collinear).
    """
    from pyspark.ml.stat import Summarizer
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils
    known = train.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("c"), F.col(features).alias("x"))
    per = known.groupBy("c").agg(Summarizer.metrics("mean", "count").summary(F.col("x")).alias("s")).select("c", "s.*").collect()
    count = {r["c"]: int(r["count"]) for r in per}
    mean = {r["c"]: r["mean"].toArray() for r in per}
    classes, total = sorted(count), sum(count.values())
    centre = sum(count[c] * mean[c] for c in classes) / total
    scatter = RowMatrix(MLUtils.convertVectorColumnsFromML(known.select("x"), "x")).computeCovariance().toArray() * (total - 1)
    between = sum(count[c] * np.outer(mean[c] - centre, mean[c] - centre) for c in classes)
    pooled = (scatter - between) / max(total - len(classes), 1)
    sd = np.sqrt(np.maximum(np.diag(pooled), 0.0))
    sd = np.where(sd > 0, sd, 1.0)
    half = np.linalg.cholesky(pooled / np.outer(sd, sd) + shrink * np.eye(len(sd)))
    coefs, icpt = {}, {}
    for c in classes:
        m = mean[c] - centre
        coefs[c] = np.linalg.solve(half.T, np.linalg.solve(half, m / sd)) / sd
        icpt[c] = float(-0.5 * coefs[c] @ (mean[c] + centre) + np.log(count[c] / total))
    return classes, coefs, icpt


def _linear(x, weights, intercept: float):
    """``weights . x + intercept`` of an array column as an expression."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(intercept)), lambda acc, v: acc + v)


def lda_predict(df: DataFrame, model, features: str = "features") -> DataFrame:
    """Score as a column expression: argmax of linear discriminants."""
    classes, coefs, icpt = model
    x = vector_to_array(features)
    scores = [F.struct(_linear(x, coefs[c], icpt[c]).alias("s"), F.lit(int(c)).alias("c")) for c in classes]
    best = F.array_max(F.array(*scores))
    return df.withColumn("prediction", best["c"].cast("double"))


# -- zero-inflated Poisson ---------------------------------------------------------------

def zip_fit(train: DataFrame, label: str = "label", iterations: int = 5):
    """ML11: zero-inflated Poisson by EM.

    E-step: the posterior weight that a zero comes from the inflation part,
    ``w = pi / (pi + (1 - pi) exp(-mu))`` (0 for positive counts) — a column.
    M-step: a weighted logistic regression for ``pi`` (label w) and a weighted
    Poisson GLM for ``mu`` (weight 1 - w). The weights of a round follow from the last two models alone, so
    each round starts from the training rows, which are kept; its own rows are kept while its two models are fitted.
    """
    base = train.select("features", F.col(label).cast("double").alias("_y")).persist(StorageLevel.MEMORY_AND_DISK)
    weight = F.when(F.col("_y") == 0, F.lit(0.5)).otherwise(F.lit(0.0))
    scored, logit, pois = base, None, None
    try:
        for _ in range(iterations):
            df = scored.select("features", "_y", weight.alias("_w")).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                # M-step: inflation probability as a two-class weighted fit
                infl = (df.select("features", F.lit(1.0).alias("_z"), F.col("_w").alias("_wt"))
                          .unionByName(df.select("features", F.lit(0.0).alias("_z"), (1 - F.col("_w")).alias("_wt"))))
                logit = LogisticRegression(featuresCol="features", labelCol="_z", weightCol="_wt", maxIter=50).fit(infl)
                pdata = df.withColumn("_pw", F.lit(1.0) - F.col("_w"))
                pois = GeneralizedLinearRegression(featuresCol="features", labelCol="_y", weightCol="_pw", family="poisson",
                                                   link="log", maxIter=25).fit(pdata)
            finally:
                df.unpersist()
            # E-step
            scored = pois.transform(logit.transform(base).withColumnRenamed("prediction", "_lp")
                                    .drop("rawPrediction")).withColumnRenamed("prediction", "_mu")
            pi = vector_to_array("probability")[1]
            weight = F.when(F.col("_y") == 0, pi / (pi + (F.lit(1.0) - pi) * F.exp(-F.col("_mu")))).otherwise(F.lit(0.0))
    finally:
        base.unpersist()
    return logit, pois


def zip_predict(df: DataFrame, model) -> DataFrame:
    """Expected count ``(1 - pi) * mu``."""
    logit, pois = model
    s = logit.transform(df).withColumnRenamed("prediction", "_lp").drop("rawPrediction")
    s = pois.transform(s).withColumnRenamed("prediction", "_mu")
    pi = vector_to_array("probability")[1]
    return s.withColumn("prediction", (F.lit(1.0) - pi) * F.col("_mu")).drop("probability", "_lp")
