"""ML, registry, model-based selection, sources and sinks (MOD*, REG*, SEL6-9, PRP*, CLN7, EVA18-19, SRC*, SNK*)."""

from __future__ import annotations

import os

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from risklib.ml import attribution as AT
from risklib.ml import models as M
from risklib.ml import pipeline as PL
from risklib.ml import selection as MS
from risklib.ml.registry import ModelRegistry
from risklib.operators import advanced as A
from risklib.operators import evaluate as EV_
from risklib.operators import prep as PR
from risklib.operators import select as SE
from risklib.operators.keyed import spread, written
from risklib.plans.common import rounded
from risklib.plans.q_eval import SQL as EVAL_SQL
from risklib.plans.q_features import FE2_ROWS_SQL
from risklib.plans.q_prep import SPLIT_SQL
from risklib.plans.sqlviews import EV, SCM
from risklib.session import checkpoint_root, scratch_path
from risklib.sources.files import read_transactions_csv
from risklib.sources.tables import scored_models, tx_events

Q, SQL = {}, {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# Model features from FE2 on tx_events. merchant_category is the label's source: never a feature.
ML_FEATURES = ["amount", "mcc", "tx_count_1h", "tx_count_6h", "tx_count_24h", "amount_zscore", "mcc_frequency",
               "hour", "day_of_week", "hour_frequency", "dow_frequency"]


def _frame(spark, sf):
    """FE2 feature rows, written to the shared checkpoint folder: what is fitted on them reads them many times,
    and the cut lineage keeps every later plan small."""
    checkpoint_root(spark)
    fe = A.create_all_advanced_features(tx_events(spark, sf)).select("transaction_id", "fraud_indicator", *ML_FEATURES)
    return written(fe, "features")


def _prepared(spark, sf, balance=None):
    tr, te = PL.prepare_data(_frame(spark, sf), "transaction_id", ML_FEATURES, balance=balance)
    return spread(tr, "transaction_id", "train"), spread(te, "transaction_id", "test")


def _folded(tr):
    return spread(PR.kfold(tr, "transaction_id", 5, label="label"), "transaction_id", "folds")


def _long_scores(wide, models):
    """One row per model and transaction from a table with one score column per model."""
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("fraud_probability")) for m in models]))
    return wide.select("transaction_id", F.col("label").cast("int").alias("true_label"), cells.alias("_s")).select(
        "_s.model", "transaction_id", "true_label", "_s.fraud_probability")


# ---------------------------------------------------------------- PRP1/CLN7
def _each(template: str, cols=ML_FEATURES) -> str:
    return ", ".join(template.replace("@", c) for c in cols)


_PREPARED_SQL = (FE2_ROWS_SQL.rstrip() + SPLIT_SQL + f""", y AS (SELECT {_each('CAST(x.@ AS DOUBLE) AS @')}, sp.*
  FROM split sp JOIN (SELECT s.*, t.amount, t.mcc FROM s JOIN tx_events t ON s.transaction_id = t.transaction_id) x
    ON sp.transaction_id = x.transaction_id),
md AS (SELECT {_each('quantile_cont(@, 0.5) AS @')} FROM y WHERE is_test = 0),
z AS (SELECT y.transaction_id, y.fraud_indicator, y.is_test, {_each('coalesce(y.@, md.@) AS @')} FROM y, md),
scale AS (SELECT {_each('avg(@) AS m_@, stddev_pop(@) AS s_@')} FROM z WHERE is_test = 0)
""")


@reg("prp1_prepare_data", _PREPARED_SQL + f"""SELECT transaction_id, CAST(fraud_indicator AS DOUBLE) AS label,
  CASE is_test WHEN 1 THEN 'test' ELSE 'train' END AS split,
  {_each('ROUND((@ - m_@) / CASE WHEN s_@ > 0 THEN s_@ ELSE 1 END, 6) AS @')} FROM z, scale""")
def prp1_prepare_data(spark, sf):
    tr, te = _prepared(spark, sf)
    u = tr.withColumn("split", F.lit("train")).unionByName(te.withColumn("split", F.lit("test")))
    x = vector_to_array("features")
    return rounded(u.select("transaction_id", "label", "split", *[x[i].alias(c) for i, c in enumerate(ML_FEATURES)]))


_CLN7 = ["amount", "mcc", "hour"]


@reg("cln7_ml_preprocessing", EV + f""", t AS (SELECT transaction_id, amount, mcc, hour(transaction_ts) AS hour,
  CASE WHEN amount > 100 THEN 'high' ELSE 'low' END AS amount_band FROM tx_events),
md AS (SELECT {_each('quantile_cont(@, 0.5) AS @', _CLN7)} FROM t),
f AS (SELECT t.transaction_id, t.amount_band, {_each('coalesce(t.@, md.@) AS @', _CLN7)} FROM t, md),
st AS (SELECT {_each('avg(@) AS m_@, stddev_pop(@) AS s_@', _CLN7)} FROM f)
SELECT transaction_id, {_each('ROUND((@ - m_@) / CASE WHEN s_@ > 0 THEN s_@ ELSE 1 END, 6) AS @', _CLN7)},
  CAST(amount_band = 'high' AS DOUBLE) AS amount_band_high, CAST(amount_band = 'low' AS DOUBLE) AS amount_band_low FROM f, st""")
def cln7_ml_preprocessing(spark, sf):
    t = tx_events(spark, sf).select("transaction_id", "amount", "mcc", F.hour("transaction_ts").alias("hour"),
                                    F.when(F.col("amount") > 100, "high").otherwise("low").alias("amount_band"))
    pm = PL.create_preprocessing_pipeline(["amount_band"], _CLN7).fit(t)
    x = vector_to_array("features")
    return rounded(pm.transform(t).select("transaction_id", *[x[i].alias(n) for i, n in enumerate(pm.names)]))


# ---------------------------------------------------------------- MOD1/MOD2/EVA18
@reg("mod2_train_logistic")
def mod2_train_logistic(spark, sf):
    tr, te = _prepared(spark, sf)
    m, _ = M.train_model(tr, "logistic", {"C": 1.0})
    return rounded(M.score(m, te, keep=["transaction_id", "label"]))


@reg("mod6_train_all_models")
def mod6_train_all_models(spark, sf):
    """All model types and the ensemble of their mean probability, compared on the test rows."""
    tr, te = _prepared(spark, sf)
    models = M.train_all_models(tr)
    wide = M.score_all(models, te, ["transaction_id", "label"], ensemble="ensemble")
    return rounded(EV_.compare_models(_long_scores(wide, [*models, "ensemble"])))


@reg("eva18_evaluation_bundle")
def eva18_evaluation_bundle(spark, sf):
    tr, te = _prepared(spark, sf, balance="weights")
    m = M.create_model("logistic", {"class_weight": "balanced"}, weight="weight").fit(tr)
    s = M.score(m, te, keep=["label"]).withColumnRenamed("label", "true_label").persist()
    cols = ["accuracy", "precision", "recall", "f1", "specificity", "false_positive_rate", "balanced_accuracy"]
    mt = EV_.classification_metrics(s, 0.5).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x"))
    rk = EV_.ranking_metrics(s).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("roc_auc", "average_precision", "brier_score")])).alias("x"))
    return rounded(mt.unionByName(rk).select("x.metric", "x.value"))


# ---------------------------------------------------------------- MOD3/MOD7/REG*
@reg("mod3_tune_logistic")
def mod3_tune_logistic(spark, sf):
    tr, _ = _prepared(spark, sf)
    tr = _folded(tr)
    grid = {"C": [0.01, 1], "penalty": ["l1", "l2"], "class_weight": [None, "balanced"]}
    _, res = M.tune_hyperparameters(tr, "logistic", grid)
    return rounded(res)


@reg("mod7_tune_all_models")
def mod7_tune_all_models(spark, sf):
    """Each type tuned on five folds over a small grid and registered; the default grids are DEFAULT_PARAM_GRIDS."""
    tr, _ = _prepared(spark, sf)
    tr = _folded(tr)
    grids = {"logistic": {"C": [0.01, 1]}, "random_forest": {"max_depth": [5, 10]}, "gradient_boosting": {"max_depth": [3, 5]}}
    res = M.tune_all_models(tr, ModelRegistry(spark, scratch_path(spark, "tuned")), list(grids), grids, features=ML_FEATURES)
    return rounded(res.drop("model_id"))


@reg("reg_registry_roundtrip")
def reg_registry_roundtrip(spark, sf):
    tr, te = _prepared(spark, sf)
    reg_ = ModelRegistry(spark, scratch_path(spark, "registry"))
    ids = []
    for t in ("logistic", "random_forest"):
        m, _ = M.train_model(tr, t)
        r = EV_.ranking_metrics(M.score(m, te, keep=["label"]).withColumnRenamed("label", "true_label")).first()
        ids.append(reg_.register_model(m, f"{t}_model", t, {"roc_auc": r["roc_auc"]}, ML_FEATURES, {"seed": 42}, "trained on tx_events features"))
    loaded = reg_.load_model(ids[0])
    assert loaded is not None
    reg_.delete_model(ids[1])
    best = reg_.get_best_model("roc_auc").first()
    return reg_.list_models().withColumn("is_best", (F.col("id") == F.lit(best["id"])).cast("int")).drop("timestamp", "id")


@reg("reg3_best_of_given_scores", f"""SELECT model AS name, 'logistic' AS type, accuracy AS metric_accuracy,
  roc_auc AS metric_roc_auc, CAST(roc_auc = max(roc_auc) OVER () AS INTEGER) AS is_best
FROM ({EVAL_SQL['eva16_compare_models']})""")
def reg3_best_of_given_scores(spark, sf):
    """REG1, REG3-REG5 on the metrics of given scores: register each, delete a third entry, list, best by metric."""
    t = tx_events(spark, sf).select(array_to_vector(F.array("amount")).alias("features"),
                                    F.col("fraud_indicator").cast("double").alias("label")).where("amount IS NOT NULL")
    m, _ = M.train_model(t, "logistic")
    reg_ = ModelRegistry(spark, scratch_path(spark, "registry"))
    for r in EV_.compare_models(scored_models(spark, sf)).collect():  # one row per model
        reg_.register_model(m, r["model"], "logistic", {"accuracy": r["accuracy"], "roc_auc": r["roc_auc"]})
    gone = reg_.register_model(m, "withdrawn", "logistic", {"accuracy": 1.0, "roc_auc": 1.0})
    assert reg_.delete_model(gone) and not reg_.delete_model(gone)
    best = reg_.get_best_model("roc_auc").first()["id"]
    return rounded(reg_.list_models().select("name", "type", "metric_accuracy", "metric_roc_auc",
                                             (F.col("id") == best).cast("int").alias("is_best")))


# ---------------------------------------------------------------- MOD4 (on given scores: SQL-checkable)
@reg("mod4_soft_voting", SCM + """SELECT transaction_id,
  ROUND(sum(fraud_probability * CASE model WHEN 'amount_mcc' THEN 0.6 ELSE 0.4 END) / sum(CASE model WHEN 'amount_mcc' THEN 0.6 ELSE 0.4 END), 6)
    AS fraud_probability FROM scored_models GROUP BY 1""")
def mod4_soft_voting(spark, sf):
    return rounded(M.soft_vote(scored_models(spark, sf), {"amount_mcc": 0.6, "amount_hour": 0.4}))


@reg("mod4_hard_voting", SCM + """SELECT transaction_id, CAST(
  sum(CASE WHEN fraud_probability >= 0.5 THEN CASE model WHEN 'amount_mcc' THEN 0.6 ELSE 0.4 END ELSE 0 END) >
  sum(CASE WHEN fraud_probability < 0.5 THEN CASE model WHEN 'amount_mcc' THEN 0.6 ELSE 0.4 END ELSE 0 END) AS INTEGER) AS prediction
  FROM scored_models GROUP BY 1""")
def mod4_hard_voting(spark, sf):
    return M.hard_vote(scored_models(spark, sf), {"amount_mcc": 0.6, "amount_hour": 0.4})


# ---------------------------------------------------------------- MOD5
@reg("mod5_stacking")
def mod5_stacking(spark, sf):
    """Meta model on out-of-fold scores of the training rows; the test rows are scored by the refitted members."""
    tr, te = _prepared(spark, sf)
    tr = _folded(tr)
    types = ["logistic", "random_forest"]
    base = tr.select("transaction_id", "label", "fold")
    for t in types:
        base = base.join(M.out_of_fold_scores(tr, t, "transaction_id", 5), "transaction_id")
    meta, _ = M.stacking(base, "transaction_id", "label", types)
    return rounded(M.score_stack(M.train_all_models(tr, types), meta, te, ["transaction_id", "label"]))


# ---------------------------------------------------------------- SEL6/SEL7/SEL8/SEL9
@reg("sel6_model_importance")
def sel6_model_importance(spark, sf):
    tr, _ = _prepared(spark, sf)
    return rounded(MS.model_importance(tr, ML_FEATURES))


@reg("sel7_rfe_cv")
def sel7_rfe_cv(spark, sf):
    tr, _ = _prepared(spark, sf)
    tr = _folded(tr)
    return rounded(MS.rfe_cv(tr, ML_FEATURES))


@reg("sel8_pca")
def sel8_pca(spark, sf):
    tr, _ = _prepared(spark, sf)
    _, table = MS.pca_reduce(tr, len(ML_FEATURES))
    return rounded(table)


@reg("sel9_combined_selection")
def sel9_combined_selection(spark, sf):
    """SEL1 -> SEL2 -> SEL6 -> SEL3, final set = model-selected AND among the top-k ANOVA features."""
    fr = _frame(spark, sf)
    v = SE.variance_threshold(fr, ML_FEATURES).where("selected = 1").select("feature")
    keep1 = [r[0] for r in v.collect()]
    c = SE.correlated_to_drop(fr, keep1, 0.95, "fraud_indicator").where("dropped = 0").select("feature")
    keep2 = [f for f in keep1 if f in {r[0] for r in c.collect()}]
    tr, _ = PL.prepare_data(fr, "transaction_id", keep2)
    imp = MS.model_importance(spread(tr, "transaction_id", "train"), keep2).where("selected = 1").select("feature")
    anova = SE.anova_f(fr, keep2, "fraud_indicator", k=max(1, len(keep2) // 2)).select("feature")
    return imp.intersect(anova)


# ---------------------------------------------------------------- EVA19
@reg("eva19_linear_attribution")
def eva19_linear_attribution(spark, sf):
    tr, te = _prepared(spark, sf)
    m, _ = M.train_model(tr, "logistic")
    return rounded(M.linear_attribution(m, te, ML_FEATURES, "transaction_id"))


_COEFS = {"amount": 0.004, "mcc": -0.02, "hour": 0.11}


@reg("eva19_attribution_given_coefficients", EV + ", t AS (SELECT transaction_id, amount, mcc, hour(transaction_ts) AS hour FROM tx_events) "
     + " UNION ALL ".join(f"SELECT transaction_id, '{c}' AS feature, ROUND({b} * ({c} - avg({c}) OVER ()), 6) AS contribution FROM t"
                          for c, b in _COEFS.items()))
def eva19_attribution_given_coefficients(spark, sf):
    t = tx_events(spark, sf).select("transaction_id", "amount", "mcc", F.hour("transaction_ts").alias("hour"))
    return rounded(M.linear_contributions(t, _COEFS, "transaction_id"))


# A score with interactions, the same text in Spark and in SQL.
_GAME = "0.01 * amount + 0.05 * mcc * hour + CASE WHEN amount > 100 AND hour < 12 THEN 2.0 ELSE 0.0 END"


def _game_sql() -> str:
    """Exact Shapley values over three features and the five first background rows: all coalitions, weighted."""
    cols = ("amount", "mcc", "hour")

    def value(inside):
        out = _GAME
        for c in cols:
            out = out.replace(c, f"{'x' if c in inside else 'z'}.{c}")
        return f"({out})"

    rows = []
    for c in cols:
        a, b = [o for o in cols if o != c]
        gain = " + ".join(f"{w} * ({value({c, *s})} - {value(set(s))})" for s, w in
                          (((), "1.0 / 3"), ((a,), "1.0 / 6"), ((b,), "1.0 / 6"), ((a, b), "1.0 / 3")))
        rows.append(f"SELECT x.transaction_id, '{c}' AS feature, ROUND(avg({gain}), 6) AS shapley, ROUND(avg({value(set())}), 6) AS base_value, "
                    f"ROUND(avg({value(set(cols))}), 6) AS prediction FROM t x, z GROUP BY 1")
    return EV + (""", t AS (SELECT transaction_id, amount, mcc, hour(transaction_ts) AS hour FROM tx_events
  WHERE amount IS NOT NULL AND mcc IS NOT NULL AND transaction_ts IS NOT NULL),
z AS (SELECT * FROM t ORDER BY transaction_id LIMIT 5) """ + " UNION ALL ".join(rows))


@reg("eva19_shapley_given_score", _game_sql())
def eva19_shapley_given_score(spark, sf):
    """All six orders of three features: exact values of a score with interactions."""
    t = tx_events(spark, sf).select("transaction_id", "amount", "mcc", F.hour("transaction_ts").alias("hour")).dropna()
    out = AT.shapley_values(t, lambda d: d.withColumn("f", F.expr(_GAME)), ["amount", "mcc", "hour"], "transaction_id",
                            t.orderBy("transaction_id").limit(5))
    return rounded(out.drop("std_error"))


@reg("eva19_shapley_of_model", EV + SPLIT_SQL + f" SELECT transaction_id, {len(ML_FEATURES)} AS features, 1 AS adds_up FROM split WHERE is_test = 1")
def eva19_shapley_of_model(spark, sf):
    """Sampled orders of the features of a boosted model over the test rows: the values add up to the margin less its mean."""
    tr, te = _prepared(spark, sf)
    m, _ = M.train_model(tr, "gradient_boosting")
    x = vector_to_array("features")
    wide = te.select("transaction_id", *[x[i].alias(c) for i, c in enumerate(ML_FEATURES)])
    ground = wide.orderBy(F.md5(F.col("transaction_id").cast("string"))).limit(4)
    out = AT.shapley_values(wide, AT.model_score(m, ML_FEATURES), ML_FEATURES, "transaction_id", ground, permutations=4)
    own = m.transform(te).select("transaction_id", vector_to_array("rawPrediction")[1].alias("_margin"))
    off = F.abs(F.sum("shapley") - (F.max("prediction") - F.max("base_value")))
    return out.groupBy("transaction_id").agg(F.count(F.lit(1)).cast("int").alias("features"), off.alias("_off"), F.max("prediction").alias("_p")).join(
        own, "transaction_id").select("transaction_id", "features", ((F.col("_off") < 1e-9) & (F.abs(F.col("_p") - F.col("_margin")) < 1e-9)).cast("int").alias("adds_up"))


@reg("eva19_tree_attribution", EV + SPLIT_SQL + "".join(
    f" {u} SELECT '{t}' AS model, transaction_id, {len(ML_FEATURES)} AS features, 1 AS adds_up FROM split WHERE is_test = 1"
    for u, t in (("", "gradient_boosting"), ("UNION ALL", "random_forest"))))
def eva19_tree_attribution(spark, sf):
    """Exact path-dependent values of a boosted model and a forest over the test rows; they add up to the model's own output."""
    tr, te = _prepared(spark, sf)
    parts = []
    for t, col in (("gradient_boosting", "rawPrediction"), ("random_forest", "probability")):
        m, _ = M.train_model(tr, t)
        a = AT.tree_attribution(m, te, ML_FEATURES, "transaction_id").groupBy("transaction_id").agg(
            F.count(F.lit(1)).cast("int").alias("features"), (F.sum("contribution") + F.max("base_value")).alias("_sum"))
        own = m.transform(te).select("transaction_id", vector_to_array(col)[1].alias("_own"))
        parts.append(a.join(own, "transaction_id").select(F.lit(t).alias("model"), "transaction_id", "features",
                                                          (F.abs(F.col("_sum") - F.col("_own")) < 1e-9).cast("int").alias("adds_up")))
    return parts[0].unionByName(parts[1])


@reg("eva19_tree_contributions")
def eva19_tree_contributions(spark, sf):
    """The contributions themselves, of the boosted model over the test rows."""
    tr, te = _prepared(spark, sf)
    m, _ = M.train_model(tr, "gradient_boosting")
    return rounded(AT.tree_attribution(m, te, ML_FEATURES, "transaction_id"))


# ---------------------------------------------------------------- SRC1/SNK1/SNK2/SNK4
@reg("src1_csv_roundtrip", EV + """SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, CAST(card_number AS VARCHAR) AS card_number,
  amount, merchant_category, fraud_indicator FROM tx_events""")
def src1_csv_roundtrip(spark, sf):
    t = tx_events(spark, sf).select("transaction_id", "card_number", "amount", "merchant_category", "fraud_indicator")
    path = scratch_path(spark, "csv")
    t.write.option("header", True).csv(path)  # SNK1 as CSV
    r = read_transactions_csv(spark, path, columns=t.columns)
    return r.select("transaction_id", "card_number", "amount", "merchant_category", "fraud_indicator")


@reg("snk1_write_processed_table", EV + """SELECT transaction_id, CAST(hour(transaction_ts) AS INTEGER) AS hour,
  CAST(date_trunc('day', transaction_ts) AS DATE)::VARCHAR AS day, amount FROM tx_events""")
def snk1_write_processed_table(spark, sf):
    t = tx_events(spark, sf).select("transaction_id", F.hour("transaction_ts").alias("hour"),
                                    F.date_format("transaction_ts", "yyyy-MM-dd").alias("day"), "amount")
    path = scratch_path(spark, "processed")
    t.write.mode("overwrite").partitionBy("day").parquet(path)   # date-partitioned: later reads prune by day
    return spark.read.parquet(path).select("transaction_id", "hour", F.col("day").cast("string").alias("day"), "amount")


@reg("snk2_export_suspicious_csv", EV + """SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, CAST(card_number AS VARCHAR) AS card_number,
  amount, merchant_category, fraud_indicator FROM tx_events WHERE amount > 300""")
def snk2_export_suspicious_csv(spark, sf):
    t = tx_events(spark, sf).where(F.col("amount") > 300).select(
        "transaction_id", "card_number", "amount", "merchant_category", "fraud_indicator")
    path = scratch_path(spark, "suspicious")
    t.write.option("header", True).csv(path)
    return read_transactions_csv(spark, path, columns=t.columns).select("transaction_id", "card_number", "amount", "merchant_category",
                                                     "fraud_indicator")


@reg("snk4_save_load_model", EV + SPLIT_SQL + " SELECT transaction_id, 1 AS same FROM split WHERE is_test = 1")
def snk4_save_load_model(spark, sf):
    from pyspark.ml.classification import LogisticRegressionModel
    tr, te = _prepared(spark, sf)
    m, _ = M.train_model(tr, "logistic")
    path = scratch_path(spark, "model")
    m.write().overwrite().save(path)
    back = LogisticRegressionModel.load(path)
    a = M.score(m, te, out="p_saved", keep=["transaction_id"])
    b = M.score(back, te, out="p_loaded", keep=["transaction_id"])
    return a.join(b, "transaction_id").select("transaction_id", (F.col("p_saved") == F.col("p_loaded")).cast("int").alias("same"))


@reg("eva19_permutation_importance")
def eva19_permutation_importance(spark, sf):
    tr, te = _prepared(spark, sf)
    m, _ = M.train_model(tr, "logistic")
    return rounded(M.permutation_importance(m, te, ML_FEATURES, "transaction_id"))
