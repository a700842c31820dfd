"""Feature and model family (rows-only checks except the baseline metrics)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import boosting as B
from ..operators import features as FE
from ..operators import models as M
from ..operators import trees as T
from ..operators.selection import row_hash, row_hash_sql
from ..session import app_key, materialize
from .catalog import query
from .q_demand import DemandChain

KEYS = ["store_type", "item_no", "period", "state"]


_FRAMES: dict = {}


def model_frame(spark, sf_dir):
    """Log-share frame (variant B) with sales class and a repeatable 80/20 split.

    Checkpointed once per session and input folder: every model query of the
    session reads the same materialised frame."""
    key = (app_key(spark), sf_dir)
    if key not in _FRAMES:
        _FRAMES.clear()
        _FRAMES[key] = _build_model_frame(spark, sf_dir)
    return _FRAMES[key]


def _build_model_frame(spark, sf_dir):
    c = DemandChain(spark, sf_dir)
    df = FE.prepare(FE.with_sales_class(c.target("B")))
    df = df.withColumn("item_no", F.col("item_no").cast("string"))
    df = FE.hash_split(df, KEYS, 80, 42)
    return materialize(df.select(*dict.fromkeys([*KEYS, *FE.CAT_COLS, *FE.NUM_COLS, "sales_quantity", "sales_class", "log_share", "is_train"])))


def _split(df):
    return df.where("is_train"), df.where("not is_train")


def _class_counts_sql():
    from . import sql_demand as SD
    from .q_demand import ARGS
    return SD.pareto_ctes(*ARGS) + """
SELECT CASE WHEN sales_quantity > 0 THEN 1 ELSE 0 END AS sales_class, count(*) AS rows FROM target_b GROUP BY 1"""


ALIGN_COLS = ["store_type", "city_type", "region", "material", "dial_color", "case_shape"]


def _alignment_sql():
    from . import sql_demand as SD
    from .q_demand import ARGS
    norm = lambda c: f"coalesce(nullif(cast({c} as varchar), ''), 'nan')"
    tr = " UNION ".join(f"SELECT '{c}' AS feature, {norm(c)} AS level FROM target_b" for c in ALIGN_COLS)
    sc = " UNION ".join(f"SELECT '{c}' AS feature, {norm(c)} AS level FROM score" for c in ALIGN_COLS)
    return SD.pareto_ctes(*ARGS) + f""",
cands AS (
  SELECT s.item_no, s.location_code, p.brand, pr.net_profit_per_unit
  FROM (SELECT DISTINCT location_code, item_no FROM sales_raw) s
  LEFT JOIN predictions p ON s.item_no = p.item_no JOIN profit pr ON s.item_no = pr.item_no),
score AS (
  SELECT c.*, sm.store_type, sm.city_type, sm.region, i.material, i.dial_color, i.case_shape
  FROM cands c JOIN store_master sm ON c.location_code = sm.store_code LEFT JOIN item_master i ON c.item_no = i.item_no),
tl AS ({tr}),
sl AS ({sc})
SELECT feature, level, 'train_only' AS side FROM (SELECT * FROM tl EXCEPT SELECT * FROM sl)
UNION ALL
SELECT feature, level, 'score_only' AS side FROM (SELECT * FROM sl EXCEPT SELECT * FROM tl)"""


@query("class_counts", ids="FE8 FE6 PF17", sql=_class_counts_sql)
def q_class_counts(spark, sf_dir):
    return FE.class_counts(model_frame(spark, sf_dir), "sales_class")


def _split_ctes():
    """The labelled model rows with their side of the split."""
    from . import sql_demand as SD
    from .q_demand import ARGS
    return SD.pareto_ctes(*ARGS) + f""",
labelled AS (SELECT *, CASE WHEN sales_quantity > 0 THEN 1 ELSE 0 END AS sales_class,
                    {row_hash_sql(42, KEYS)} % 100 < 80 AS is_train FROM target_b)"""


@query("split_class_counts", ids="FE6 FE8", sql=lambda: _split_ctes() + """
SELECT is_train, sales_class, count(*) AS rows FROM labelled GROUP BY 1, 2""")
def q_split_counts(spark, sf_dir):
    return model_frame(spark, sf_dir).groupBy("is_train", "sales_class").agg(F.count("*").alias("rows"))


def _oversampled_sql():
    """Every class as often as the largest; the rows of the remainder are the first by hash."""
    return _split_ctes() + f""",
tr AS (SELECT *, {row_hash_sql(43, KEYS)} AS h FROM labelled WHERE is_train),
class_sizes AS (SELECT sales_class, count(*) AS n, max(count(*)) OVER () AS most FROM tr GROUP BY 1),
ranked AS (SELECT t.*, n, most, row_number() OVER (PARTITION BY sales_class ORDER BY h) AS place FROM tr t JOIN class_sizes USING (sales_class))
SELECT sales_class, cast(sum(most // n + CASE WHEN place <= most % n THEN 1 ELSE 0 END) as bigint) AS rows,
       cast(sum((most // n + CASE WHEN place <= most % n THEN 1 ELSE 0 END) * (h % 1000003)) as bigint) AS key_sum
FROM ranked GROUP BY 1"""


@query("oversampled_class_counts", ids="FE7 FE8", sql=_oversampled_sql)
def q_oversampled(spark, sf_dir):
    train, _ = _split(model_frame(spark, sf_dir))
    grown = FE.oversample(train, "sales_class", KEYS).withColumn("h", row_hash(43, KEYS) % 1000003)
    return grown.groupBy("sales_class").agg(F.count("*").alias("rows"), F.sum("h").alias("key_sum"))


@query("level_alignment", ids="FE5 FE9 FE10", sql=_alignment_sql)
def q_alignment(spark, sf_dir):
    from ..operators import assortment as A
    from ..sources.testdata import RetailTables
    t = RetailTables(spark, sf_dir, "sku")
    train = model_frame(spark, sf_dir)
    score = FE.scoring_frame(A.candidates(t.sales_raw, t.predictions, t.profit), t.store_master,
                             t.item_master, 1)
    return FE.level_alignment(train, FE.prepare(score), ALIGN_COLS)


def _reg_predictions(spark, sf_dir, estimator):
    df = model_frame(spark, sf_dir).where(F.col("log_share").isNotNull())
    train, test = _split(df)
    model = M.fit_pipeline(train.withColumnRenamed("log_share", "label"), estimator)
    pred = model.transform(test.withColumnRenamed("log_share", "label"))
    return pred.select(*KEYS, "label", "prediction")


@query("ml_linear_regression", ids="ML1 ML19")
def q_lr(spark, sf_dir):
    return _reg_predictions(spark, sf_dir, M.linear_regression())


@query("ml_linear_regression_metrics", ids="ML17")
def q_lr_metrics(spark, sf_dir):
    return M.regression_metrics(_reg_predictions(spark, sf_dir, M.linear_regression()))


@query("ml_gbt_regression_metrics", ids="ML3 ML17")
def q_gbt(spark, sf_dir):
    return M.regression_metrics(_reg_predictions(spark, sf_dir, M.gbt_regressor()))


def _clf_predictions(spark, sf_dir, estimator, oversample=True, num_cols=None):
    df = model_frame(spark, sf_dir)
    train, test = _split(df)
    if oversample:
        train = FE.oversample(train, "sales_class", KEYS)
    model = M.fit_pipeline(train.withColumn("label", F.col("sales_class").cast("double")), estimator,
                           num_cols=num_cols)
    pred = model.transform(test.withColumn("label", F.col("sales_class").cast("double")))
    return pred.select(*KEYS, "label", "prediction")


@query("ml_logistic_rates", ids="ML2 ML18 ML20 U5 FE4")
def q_logit(spark, sf_dir):
    return M.classification_rates(_clf_predictions(spark, sf_dir, M.logistic_regression()))


@query("ml_decision_tree_rates", ids="ML5 ML20")
def q_tree(spark, sf_dir):
    return M.classification_rates(_clf_predictions(spark, sf_dir, M.decision_tree(min_leaf=100)))


@query("ml_naive_bayes_rates", ids="ML8 ML20")
def q_nb(spark, sf_dir):
    # multinomial counts must be non-negative: one-hot attributes only
    return M.classification_rates(_clf_predictions(spark, sf_dir, M.naive_bayes(), num_cols=["case_size"]))


@query("ml_gbt_classifier_rates", ids="ML4 ML20")
def q_gbtc(spark, sf_dir):
    return M.classification_rates(_clf_predictions(spark, sf_dir, M.gbt_classifier()))


def _rates_sql(rows: str) -> str:
    """ML18, ML20, U5 of the rows (label, prediction) that ``rows`` selects."""
    return f"""
SELECT *, cast(tn as double) / nullif(cast(tn + fp as double), 0) * 100 AS tn_pct, cast(fp as double) / nullif(cast(tn + fp as double), 0) * 100 AS fp_pct,
       cast(fn as double) / nullif(cast(fn + tp as double), 0) * 100 AS fn_pct, cast(tp as double) / nullif(cast(fn + tp as double), 0) * 100 AS tp_pct,
       cast(tn + tp as double) / nullif(cast(tn + fp + fn + tp as double), 0) AS accuracy,
       (cast(tp as double) / nullif(cast(fn + tp as double), 0) + cast(tn as double) / nullif(cast(tn + fp as double), 0)) / 2 AS auc_hard
FROM (SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
             count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM ({rows}))"""


def _majority_sql():
    return _split_ctes() + _rates_sql("""
  SELECT sales_class AS label, (SELECT sales_class FROM labelled WHERE is_train GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS prediction
  FROM labelled WHERE NOT is_train""")


def _last_period_sql():
    return _split_ctes() + _rates_sql("""
  SELECT t.sales_class AS label, coalesce(s.sold, 0) AS prediction FROM labelled t LEFT JOIN (
    SELECT item_no, max(sales_class) AS sold FROM labelled WHERE is_train GROUP BY 1) s ON t.item_no = s.item_no WHERE NOT t.is_train""")


@query("sold_before_rates", ids="ML18 ML20 U5", sql=_last_period_sql)
def q_sold_before(spark, sf_dir):
    """The rates of a rule that both engines compute: an item sells if it sold anywhere in the training rows."""
    train, test = _split(model_frame(spark, sf_dir))
    sold = train.groupBy("item_no").agg(F.max("sales_class").alias("sold"))
    return M.classification_rates(test.join(sold, "item_no", "left").select(
        F.col("sales_class").alias("label"), F.coalesce("sold", F.lit(0)).alias("prediction")))


@query("ml_majority_baseline_rates", ids="ML12 ML20", sql=_majority_sql)
def q_major(spark, sf_dir):
    df = model_frame(spark, sf_dir).withColumn("label", F.col("sales_class"))
    train, test = _split(df)
    return M.classification_rates(M.majority_baseline(train, test))


@query("ml_lda_rates", ids="ML9 ML20")
def q_lda(spark, sf_dir):
    df = model_frame(spark, sf_dir).withColumn("label", F.col("sales_class").cast("double"))
    train, test = _split(df)
    pre = FE.one_hot_pipeline().fit(train)
    tr, te = pre.transform(train), pre.transform(test)
    model = M.lda_fit(tr)
    return M.classification_rates(M.lda_predict(te, model))


@query("ml_poisson_metrics", ids="ML10 ML17")
def q_poisson(spark, sf_dir):
    df = model_frame(spark, sf_dir).withColumn("label", F.round("sales_quantity"))
    train, test = _split(df)
    model = M.fit_pipeline(train, M.poisson_glm())
    return M.regression_metrics(model.transform(test))


def _prepped(spark, sf_dir, label_expr):
    """Training frame with one-hot features, fitted once (the pipeline is reused per fit)."""
    df = model_frame(spark, sf_dir).withColumn("label", label_expr)
    train, test = _split(df)
    pre = FE.one_hot_pipeline().fit(train)
    return pre.transform(train), pre.transform(test)


@query("ml_min_leaf_sweep", ids="ML6 ML5 ML20")
def q_sweep(spark, sf_dir):
    """All trees grow together; the test rows are counted in their leaves on the way."""
    train, test = _split(model_frame(spark, sf_dir).withColumn("label", F.col("sales_class")))
    train = FE.oversample(train, "label", KEYS)
    trees = [M.decision_tree(min_leaf=leaf) for leaf in range(100, 1000, 25)]
    found = T.sweep(train, test, [T.Candidate(x.getMaxDepth(), x.getImpurity(), x.getMinWeightFractionPerNode(), x.getMinInstancesPerNode())
                                  for x in trees], KEYS)
    rows = [(trees[i].getMinInstancesPerNode(), y, p, n) for i, y, p, n in found]
    return M.classification_rates(spark.createDataFrame(rows, "min_leaf int, label int, prediction int, n long"),
                                  by=["min_leaf"], rows="n").orderBy("min_leaf")


@query("ml_cross_val_r2", ids="ML15 ML1")
def q_cv_r2(spark, sf_dir):
    df = model_frame(spark, sf_dir).where(F.col("log_share").isNotNull()).withColumnRenamed("log_share", "label")
    train, _ = _split(df)
    cvm = M.cross_validate(train, M.linear_regression(), [{}], KEYS, metric="r2", folds=5)
    return spark.createDataFrame([(5, float(cvm.avgMetrics[0]))], "folds int, mean_r2 double")


def _boost_data(df, apart=None):
    """Rows with a log share, binned for the boosted trees."""
    return B.binned(df, FE.CAT_COLS, FE.NUM_COLS, "log_share", KEYS, folds=5, apart=apart)


@query("ml_gbt_random_search", ids="ML13 ML3")
def q_gbt_search(spark, sf_dir):
    """20 random candidates x 5 folds, grown together."""
    train, _ = _split(model_frame(spark, sf_dir))
    points = M.random_points(BOOST_GRID, 20, seed=42)
    found = B.search(_boost_data(train), [B.Boost(**p) for p in points], folds=5)
    best = max(found, key=lambda x: x[1])[0]
    rows = [(i, float(r2), float(mse), i == best, str(points[i])) for i, r2, mse in found]
    return spark.createDataFrame(rows, "candidate int, mean_r2 double, mean_mse double, is_best boolean, params string")


@query("ml_gbt_tuned_metrics", ids="ML3 ML15 ML17")
def q_gbt_tuned(spark, sf_dir):
    """The tuned settings: the fit on the training rows scored on the test rows, and 5-fold cross-validation, in one batch.

    ``fold`` -1 is the fit on all training rows. Test rows are a fold of their own, which every model leaves out.
    """
    data = _boost_data(model_frame(spark, sf_dir), apart=~F.col("is_train"))
    models = [replace(TUNED, fold=f, skip=5) for f in range(5)] + [replace(TUNED, fold=5)]
    scores = B.Batch(data, models).fit().scores()
    return scores.select(F.when(F.col("model") == 5, -1).otherwise(F.col("model")).cast("int").alias("fold"), "n", "rmse", "r2")


#: fixed values: leaf sizes as a share of the rows (Spark takes less than a half), depths and learning rates
LEAF_SHARES = [round(0.05 + i * 0.01, 2) for i in range(45)]
DEPTHS = [3, 4, 5, 6, 7, 8, 10, 12, 15]
RATES = [0.05, 0.1, 0.15, 0.2, 0.25, 0.3]
ROW_SHARES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
#: fixed values: the boosted search space, and the settings that the search found
BOOST_GRID = {"rate": RATES, "depth": DEPTHS, "rows": ROW_SHARES, "columns": ROW_SHARES, "trees": [3, 5, 7, 10],
              "min_child": [1, 3, 5, 7]}
TUNED = B.Boost(depth=3, rate=0.2, trees=100, rows=0.3, columns=0.9, level_columns=0.4, min_child=1, l1=0.4, l2=0.1)


def _auc_search(spark, sf_dir, est, grid, search):
    """ML14: 10 random candidates by the area under the ROC curve over 5 folds, all of them grown together by ``search``."""
    train, _ = _split(model_frame(spark, sf_dir).withColumn("label", F.col("sales_class").cast("double")))
    points = M.random_grid(grid, 10, seed=42)
    return _auc_rows(spark, [{p.name: v for p, v in x.items()} for x in points], search(train, [est.copy(x) for x in points]))


def _auc_rows(spark, points, found):
    best = max(range(len(points)), key=lambda i: found[i])
    rows = [(i, float(found[i]), i == best, str(points[i])) for i in range(len(points))]
    return spark.createDataFrame(rows, "candidate int, mean_auc double, is_best boolean, params string")


@query("ml_random_forest_search", ids="ML7 ML14")
def q_rf_search(spark, sf_dir):
    est = M.random_forest()
    of = lambda e: T.Candidate(e.getMaxDepth(), e.getImpurity(), e.getMinWeightFractionPerNode(), e.getMinInstancesPerNode())
    return _auc_search(spark, sf_dir, est, {est.maxDepth: list(range(1, 31)), est.impurity: ["gini", "entropy"],
                                            est.minWeightFractionPerNode: LEAF_SHARES}, lambda train, some: T.forest_search(
        train, [of(e) for e in some], KEYS, 5, "label", est.getNumTrees(), est.getFeatureSubsetStrategy(), est.getSubsamplingRate(), est.getSeed()))


@query("ml_tree_search", ids="ML14 ML5")
def q_tree_search(spark, sf_dir):
    """10 random candidates x 5 folds, grown together."""
    train, _ = _split(model_frame(spark, sf_dir).withColumn("label", F.col("sales_class")))
    points = M.random_points({"maxDepth": list(range(1, 31)), "impurity": ["gini", "entropy"],
                              "minWeightFractionPerNode": LEAF_SHARES}, 10, seed=42)
    found = T.search(train, [T.Candidate(p["maxDepth"], p["impurity"], p["minWeightFractionPerNode"]) for p in points], KEYS, folds=5)
    return _auc_rows(spark, points, found)


@query("ml_boosted_class_search", ids="ML14 ML4")
def q_boosted_search(spark, sf_dir):
    est = M.gbt_classifier()
    return _auc_search(spark, sf_dir, est, {est.maxDepth: DEPTHS, est.stepSize: RATES, est.subsamplingRate: ROW_SHARES,
                                            est.minWeightFractionPerNode: LEAF_SHARES},
                       lambda train, some: B.class_search(train, some, KEYS, 5, FE.CAT_COLS, FE.NUM_COLS))


def _scoring_rows(spark, sf_dir, df):
    """FE10, J21, PF23: every SKU retailed at a store as the models know it.

    The item lumping of the training frame is replayed (lumped SKUs are 'Others' with the usual attributes), prices
    and stock are those of the last period known for the store type and item, or else for the item.
    ``own_item`` and ``own_brand`` keep the SKU.
    """
    from ..operators import assortment as A
    from ..operators import pareto as PA
    c = DemandChain(spark, sf_dir)
    t = c.t
    cand = A.candidates(t.sales_raw, t.predictions, t.profit).drop("log_share")
    next_period = df.agg(F.max("period")).head()[0] + 1
    score = (FE.scoring_frame(cand, t.store_master, t.item_master, next_period)
             .withColumn("own_item", F.col("item_no")).withColumn("own_brand", F.col("brand")))
    lumped = c.mapping.select("item_no", "brand", F.col("lumped").alias("_lumped"))
    score = score.join(lumped, ["item_no", "brand"], "left")
    hit = F.coalesce(F.col("_lumped"), F.lit(False))
    usual = PA.global_modes(c.kept, PA.ITEM_COLS).head()
    types = dict(score.dtypes)
    for a in PA.ITEM_COLS:
        score = score.withColumn(a, F.when(hit, F.lit(usual[f"_mode_{a}"]).cast(types[a])).otherwise(F.col(a)))
    for k in ("item_no", "brand"):
        score = score.withColumn(k, F.when(hit, F.lit("Others")).otherwise(F.col(k).cast("string")))
    known = ["stock_prevailing_mrp", "available_quantity"]
    near = FE.latest_features(df, ["store_type", "item_no"], known)
    item = FE.latest_features(df, ["item_no"], known).select("item_no", *[F.col(x).alias(f"_{x}") for x in known])
    score = score.join(near, ["store_type", "item_no"], "left").join(item, "item_no", "left")
    for x in known:
        score = score.withColumn(x, F.coalesce(F.col(x), F.col(f"_{x}")))
    return FE.prepare(score.drop("_lumped", *[f"_{x}" for x in known]))


@query("ml_two_stage_assortment", ids="ML21 FE10 OPT2")
def q_two_stage(spark, sf_dir):
    """Classify whether a (store, SKU) sells, regress the log share of the
    predicted sellers, and feed the predictions to the greedy assortment."""
    from ..operators import assortment as A
    from .q_assortment import ASSORTMENT_SIZE, MARKET_SIZE
    df = model_frame(spark, sf_dir)
    train, _ = _split(df)
    clf = M.fit_pipeline(FE.oversample(train, "sales_class", KEYS).withColumn("label", F.col("sales_class").cast("double")),
                         M.logistic_regression())
    reg = M.fit_pipeline(train.where(F.col("log_share").isNotNull()).withColumnRenamed("log_share", "label"),
                         M.linear_regression())
    score = _scoring_rows(spark, sf_dir, df)
    sellers = clf.transform(score).where(F.col("prediction") == 1.0).select(*score.columns)
    pred = reg.transform(sellers).select(F.col("location_code"), F.col("own_brand").alias("brand"),
                                         F.col("own_item").alias("item_no"),
                                         F.col("prediction").alias("log_share"), "net_profit_per_unit")
    return A.greedy_assortment(pred, ASSORTMENT_SIZE, MARKET_SIZE)


@query("ml_kprototypes", ids="ML16")
def q_kproto(spark, sf_dir):
    from ..operators.clustering import kprototypes
    df = model_frame(spark, sf_dir)
    clustered, _ = kprototypes(df, ["stock_prevailing_mrp", "case_size"], ["store_type", "material"], k=15)
    return clustered.groupBy("cluster").agg(F.count("*").alias("rows"))


@query("ml_zero_inflated_poisson", ids="ML11 ML17")
def q_zip(spark, sf_dir):
    tr, te = _prepped(spark, sf_dir, F.round("sales_quantity"))
    model = M.zip_fit(tr.select("features", "label"), iterations=4)
    return M.regression_metrics(M.zip_predict(te.select("features", "label"), model))
