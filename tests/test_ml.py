"""ML layer smoke + invariants on sf0.001: registry round trip, voting, tuning table, PCA variance."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

import __spark_entry__ as E
from risklib.ml import models as M
from risklib.ml.pipeline import create_preprocessing_pipeline
from risklib.operators import prep as PR
from tests.conftest import SF0001


def test_registry_roundtrip(spark):
    df = E.queries()["reg_registry_roundtrip"](spark, SF0001).toPandas()
    assert len(df) == 1                      # two registered, one deleted (tombstone)
    assert df.is_best.iloc[0] == 1
    assert "metric_roc_auc" in df.columns


def test_soft_vote_is_weighted_mean(spark):
    out = E.queries()["mod4_soft_voting"](spark, SF0001)
    p = out.agg(F.min("fraud_probability"), F.max("fraud_probability")).first()
    assert 0.0 <= p[0] <= p[1] <= 1.0


def test_pca_cumulative_reaches_threshold(spark):
    t = E.queries()["sel8_pca"](spark, SF0001).orderBy("component").toPandas()
    assert t.cumulative.iloc[-1] >= 0.95 - 1e-9
    assert (t.explained_variance.diff().dropna() <= 1e-12).all()


def test_tuning_reports_every_combination(spark):
    t = E.queries()["mod3_tune_logistic"](spark, SF0001).toPandas()
    # two values of C, two penalties, with and without class weights
    assert len(t) == 8 and t.params.nunique() == 8 and t.roc_auc.between(0, 1).all()
    assert t.params.str.contains("class_weight").sum() == 4


def test_elimination_tries_every_default_size(spark):
    t = E.queries()["sel7_rfe_cv"](spark, SF0001).toPandas()
    assert sorted(t.n_features) == [5, 6, 7, 8, 9, 10, 11] and t.roc_auc.between(0, 1).all()


def _rows(spark):
    r = [(i, float(i % 7), float((i * 5) % 11), float(i % 7 > 3)) for i in range(200)]
    df = spark.createDataFrame(r, "id long, a double, b double, label double")
    return df.select("id", array_to_vector(F.array("a", "b")).alias("features"), "label")


def test_ensemble_is_the_weighted_mean_and_equal_settings_are_fitted_once(spark):
    models = M.train_all_models(_rows(spark), ["logistic", "xgboost", "lightgbm"])
    assert list(models) == ["logistic", "xgboost", "lightgbm"] and models["xgboost"] is models["lightgbm"]
    s = M.score_all(models, _rows(spark), ["id"], "mix", {"logistic": 3, "xgboost": 1, "lightgbm": 0})
    assert s.columns == ["id", "logistic", "xgboost", "lightgbm", "mix"]
    assert s.where(F.abs(F.col("mix") - (F.col("logistic") * 3 + F.col("xgboost")) / 4) > 1e-12).count() == 0


def test_weights_and_c_change_the_model(spark):
    df = _rows(spark).withColumn("w", F.when(F.col("label") == 1, 5.0).otherwise(1.0))
    plain = M.train_all_models(df, ["logistic"], {"logistic": {"C": 100.0}})["logistic"]
    strict = M.train_all_models(df, ["logistic"], {"logistic": {"C": 0.001}})["logistic"]
    weighted = M.train_all_models(df, ["logistic"], {"logistic": {"C": 100.0, "class_weight": "balanced"}}, weight="w")["logistic"]
    assert abs(strict.coefficients[0]) < abs(plain.coefficients[0])
    assert weighted.intercept != plain.intercept


def test_stack_scores_unseen_rows(spark):
    df = PR.kfold(_rows(spark), "id", 4, label="label")
    base = df.select("id", "label", "fold").join(M.out_of_fold_scores(df, "logistic", "id", 4), "id")
    meta, _ = M.stacking(base, "id", "label", ["logistic"])
    new = _rows(spark).withColumn("id", F.col("id") + 1000)
    out = M.score_stack(M.train_all_models(df, ["logistic"]), meta, new, ["id"])
    assert out.count() == 200 and out.where("stacked_probability NOT BETWEEN 0 AND 1").count() == 0


def test_preprocessing_fills_scales_numbers_only_and_ignores_unseen_levels(spark):
    schema = "id long, x double, g string"
    train = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None), (4, 8.0, "b")], schema)
    fitted = create_preprocessing_pipeline(["g"], ["x"]).fit(train)
    assert fitted.names == ["x", "g_a", "g_b"]
    new = spark.createDataFrame([(1, 3.0, "c"), (2, None, None)], schema)
    got = {r.id: list(r.features) for r in fitted.transform(new).collect()}
    sd = (((1 - 3.75) ** 2 + 2 * 0.75 ** 2 + 4.25 ** 2) / 4) ** 0.5     # filled: 1, 3, 3, 8
    assert got[1][1:] == [0.0, 0.0] and abs(got[1][0] - (3 - 3.75) / sd) < 1e-12
    assert got[2][1:] == [0.0, 1.0] and got[2][0] == got[1][0]
    with pytest.raises(ValueError):
        create_preprocessing_pipeline(["g"], [], max_levels=1).fit(train)


def test_tuning_equals_cross_validator_and_fits_the_best_once(spark, monkeypatch):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(Vectors.dense(x), float(x[0] + e > 0), i % 3) for i, (x, e) in enumerate(
        zip(rng.normal(size=(300, 2)).tolist(), rng.normal(size=300).tolist()))], ["features", "label", "fold"]).repartition(1).checkpoint()
    fits = []
    whole = M.LogisticRegression._fit
    monkeypatch.setattr(M.LogisticRegression, "_fit", lambda self, d: (fits.append(1), whole(self, d))[1])
    _, res = M.tune_hyperparameters(rows, "logistic", {"C": [0.001, 1], "class_weight": [None, "balanced"]})
    assert len(fits) == 3 * 4 + 1  # one refit, not one per weight setting
    est = M.create_model("logistic")
    maps = [{est.regParam: 1 / (c * 300)} for c in (0.001, 1)]
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(), foldCol="fold", numFolds=3).fit(rows)
    assert np.allclose([r["roc_auc"] for r in res.collect()][:2], cv.avgMetrics, atol=1e-12)
    with pytest.raises(ValueError):
        M.cross_validated(rows.where("fold <> 1"), est, maps, "fold", 3)


def test_types_that_share_a_fit_are_scored_once(spark, monkeypatch):
    rows = spark.createDataFrame([(i, Vectors.dense(float(i % 7), float(i % 3)), float(i % 7 > 3)) for i in range(60)],
                                 ["transaction_id", "features", "label"])
    models = M.train_all_models(rows)
    scored = []
    for kind in {type(m) for m in models.values()}:
        whole = kind.transform
        monkeypatch.setattr(kind, "transform", lambda self, d, whole=whole: (scored.append(type(self)), whole(self, d))[1])
    out = M.score_all(models, rows, ["transaction_id"], ensemble="mean").collect()
    assert len(scored) == 3 and len(out) == 60
    for r in out:
        assert r["xgboost"] == r["lightgbm"] == r["gradient_boosting"]
        assert abs(r["mean"] - (r["logistic"] + r["random_forest"] + 3 * r["xgboost"]) / 5) < 1e-12
