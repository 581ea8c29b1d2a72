"""Model factory, training, tuning and ensembles on Spark ML (MOD1-MOD7, EVA18, EVA19).

Inputs are DataFrames with a ``features`` vector, a ``label`` double and
optionally ``weight`` and ``fold`` columns. Fitting runs on the executors
(Spark ML); the driver only holds fitted parameters.
"""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
MODEL_TYPES = ["logistic", "random_forest", "xgboost", "lightgbm", "gradient_boosting"]

# Default search grids (reference parameter names).
DEFAULT_PARAM_GRIDS = {
    "logistic": {"C": [0.001, 0.01, 0.1, 1, 10, 100], "class_weight": [None, "balanced"],
                 "solver": ["liblinear", "saga"], "penalty": ["l1", "l2"]},
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [None, 5, 10, 20],
                      "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
                      "class_weight": [None, "balanced"]},
    "xgboost": {"n_estimators": [50, 100, 200], "max_depth": [3, 5, 7, 9], "learning_rate": [0.01, 0.1, 0.2],
                "subsample": [0.8, 0.9, 1.0], "colsample_bytree": [0.8, 0.9, 1.0], "scale_pos_weight": [1, 5, 10]},
    "lightgbm": {"n_estimators": [50, 100, 200], "num_leaves": [31, 50, 100], "learning_rate": [0.01, 0.05, 0.1],
                 "subsample": [0.8, 0.9, 1.0], "colsample_bytree": [0.8, 0.9, 1.0], "class_weight": [None, "balanced"]},
    "gradient_boosting": {"n_estimators": [50, 100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.1, 0.2],
                          "subsample": [0.8, 0.9, 1.0], "min_samples_split": [2, 5, 10]},
}
RANDOM_SEARCH_DRAWS = 10
MAX_FULL_GRID_PARAMS = 5


def _spark_params(model_type: str, params: dict | None, n_rows: int | None = None) -> dict:
    """Map the reference's parameter names onto Spark ML's."""
    p = dict(params or {})
    out: dict = {}
    if model_type == "logistic":
        if "C" in p:
            if not n_rows:
                raise ValueError("C needs n_rows: regParam = 1 / (C * n_rows)")
            out["regParam"] = 1.0 / (float(p["C"]) * n_rows)
        if p.get("penalty") == "l1":
            out["elasticNetParam"] = 1.0
        elif p.get("penalty") == "l2":
            out["elasticNetParam"] = 0.0
        if "max_iter" in p:
            out["maxIter"] = int(p["max_iter"])
    else:
        if "n_estimators" in p:
            out["numTrees" if model_type == "random_forest" else "maxIter"] = int(p["n_estimators"])
        if "max_depth" in p:
            out["maxDepth"] = 30 if p["max_depth"] is None else int(p["max_depth"])
        if "num_leaves" in p:
            out["maxDepth"] = max(1, min(30, int(p["num_leaves"]).bit_length() - 1))
        if "min_samples_leaf" in p:
            out["minInstancesPerNode"] = int(p["min_samples_leaf"])
        if "learning_rate" in p and model_type != "random_forest":
            out["stepSize"] = float(p["learning_rate"])
        if "subsample" in p:
            out["subsamplingRate"] = float(p["subsample"])
        if "colsample_bytree" in p:
            out["featureSubsetStrategy"] = str(p["colsample_bytree"])
    return out


def uses_weights(params: dict | None) -> bool:
    p = params or {}
    return p.get("class_weight") == "balanced" or float(p.get("scale_pos_weight", 1)) != 1


def create_model(model_type: str, params: dict | None = None, n_rows: int | None = None,
                 features: str = "features", label: str = "label", weight: str | None = None):
    """MOD1: Spark estimator for a reference model type (boosters map to GBTClassifier)."""
    kw = dict(featuresCol=features, labelCol=label)
    sp = _spark_params(model_type, params, n_rows)
    if weight and uses_weights(params):
        kw["weightCol"] = weight
    if model_type == "logistic":
        return LogisticRegression(**kw, **sp)
    if model_type == "random_forest":
        return RandomForestClassifier(seed=SEED, **kw, **sp)
    if model_type in ("xgboost", "lightgbm", "gradient_boosting"):
        return GBTClassifier(seed=SEED, **kw, **sp)
    raise ValueError(f"Unrecognized model type: {model_type}")


def train_model(train: DataFrame, model_type: str, params: dict | None = None, **kw) -> tuple[Model, float]:
    """MOD2: fit and wall time (seconds, measured on the driver)."""
    if model_type == "logistic" and "C" in (params or {}) and not kw.get("n_rows"):
        kw["n_rows"] = train.count()
    est = create_model(model_type, params, **kw)
    t0 = time.time()
    m = est.fit(train)
    return m, time.time() - t0


def train_all_models(train: DataFrame, types: Sequence[str] = MODEL_TYPES, params: dict | None = None,
                     weight: str | None = None) -> dict[str, Model]:
    """MOD6: one fitted model per type; types that map to the same Spark estimator and settings share one fit."""
    n_rows = train.count()  # C -> regParam = 1 / (C * n)
    fitted: dict = {}
    out = {}
    for t in types:
        p = (params or {}).get(t)
        est = create_model(t, p, n_rows, weight=weight)
        same = (type(est), str(sorted(_spark_params(t, p, n_rows).items())), weight if weight and uses_weights(p) else None)
        if same not in fitted:
            fitted[same] = est.fit(train)
        out[t] = fitted[same]
    return out


def score_all(models: dict[str, Model], df: DataFrame, keep: Sequence[str] = (), ensemble: str | None = None,
              weights: dict[str, float] | None = None) -> DataFrame:
    """One probability column per model (and their weighted mean, ``ensemble``), all from one pass over the rows."""
    d, scored = df, {}
    for name, m in models.items():
        same = scored.setdefault(id(m), name)  # types that share one fit share its scores
        d = (positive_probability(m.transform(d), out=name).drop("rawPrediction", "probability", "prediction") if same == name
             else d.withColumn(name, F.col(same)))
    if ensemble is not None:
        w = weights or dict.fromkeys(models, 1.0)
        d = d.withColumn(ensemble, sum(F.col(n) * float(w[n]) for n in models) / F.lit(float(sum(w[n] for n in models))))
    return d.select(*keep, *models, *([ensemble] if ensemble is not None else []))


def positive_probability(df: DataFrame, col: str = "probability", out: str = "fraud_probability") -> DataFrame:
    return df.withColumn(out, vector_to_array(F.col(col))[1])


def score(model: Model, df: DataFrame, out: str = "fraud_probability", keep: Sequence[str] = ()) -> DataFrame:
    p = positive_probability(model.transform(df), out=out)
    return p.select(*keep, out)


def param_grid(model_type: str, grid: dict | None = None, n_iter: int = RANDOM_SEARCH_DRAWS, seed: int = SEED) -> list[dict]:
    """Full grid when at most 5 parameters, otherwise ``n_iter`` seeded random draws (MOD3)."""
    grid = grid or DEFAULT_PARAM_GRIDS[model_type]
    names = list(grid)
    combos = [dict(zip(names, v)) for v in itertools.product(*[grid[n] for n in names])]
    if len(names) <= MAX_FULL_GRID_PARAMS:
        return combos
    rnd = random.Random(seed)
    return rnd.sample(combos, min(n_iter, len(combos)))


def tune_hyperparameters(train: DataFrame, model_type: str, grid: dict | None = None, fold_col: str = "fold",
                         n_iter: int = RANDOM_SEARCH_DRAWS, parallelism: int = 4, n_rows: int | None = None):
    """MOD3: cross-validation over the fold column (stratified folds from ``kfold``), metric areaUnderROC.

    Parameter dicts map to Spark params and a weight setting (``class_weight``
    "balanced", or ``scale_pos_weight`` s); each setting is cross-validated
    with its own weight column. Combos that map to the same Spark params and
    weights are evaluated once; parameters without a Spark equivalent
    (``solver``, ``min_samples_split``) are named in ``ignored``. Returns (best
    model, DataFrame of params, ignored, roc_auc).
    """
    combos = param_grid(model_type, grid, n_iter)
    if n_rows is None and any("C" in c for c in combos):
        n_rows = train.count()
    groups: dict[tuple, list[dict]] = {}
    ignored = set()
    for c in combos:
        ignored |= {k for k in c if k in ("solver", "min_samples_split")}
        sp = _spark_params(model_type, c, n_rows)
        have = groups.setdefault((c.get("class_weight"), float(c.get("scale_pos_weight", 1))), [])
        if sp not in have:
            have.append(sp)
    rows, best_of, best_auc = [], None, None
    n_folds = train.agg(F.max(fold_col)).first()[0] + 1
    for (balanced, scale), sps in groups.items():
        weighted = balanced == "balanced" or scale != 1
        data = weighted_rows(train, balanced, scale) if weighted else train
        est = create_model(model_type, {"class_weight": "balanced"} if weighted else None, n_rows,
                           weight=WEIGHT if weighted else None)
        maps = [{est.getParam(k): v for k, v in sp.items()} for sp in sps]
        aucs = cross_validated(data, est, maps, fold_col, n_folds, parallelism)
        note = {"class_weight": balanced} if balanced else {"scale_pos_weight": scale} if scale != 1 else {}
        for sp, auc in zip(sps, aucs):
            rows.append((str({**dict(sorted(sp.items())), **note}), ",".join(sorted(ignored)), float(auc)))
        if best_of is None or max(aucs) > best_auc:
            best_of, best_auc = (est, maps[aucs.index(max(aucs))], data), max(aucs)
    est, params, data = best_of  # only the best of all settings is fitted on all rows
    return est.fit(data, params), train.sparkSession.createDataFrame(rows, "params string, ignored string, roc_auc double")


def cross_validated(data: DataFrame, est, maps: Sequence[dict], fold_col: str, n_folds: int, parallelism: int = 4) -> list[float]:
    """Mean areaUnderROC of every parameter map over the folds, as Spark's CrossValidator gives it.

    CrossValidator checks the fold number of every row in a Python function, twice a fold; here the folds are plain filters.
    Raises ValueError when a fold leaves nothing to fit on or to score.
    """
    ev = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    total = [0.0] * len(maps)
    for f in range(n_folds):
        train, held = data.where(F.col(fold_col) != f).persist(), data.where(F.col(fold_col) == f).persist()
        try:
            if train.isEmpty() or held.isEmpty():
                raise ValueError(f"fold {f} leaves no rows to fit on or to score")
            # the threads carry the session's local properties
            with ThreadPool(min(parallelism, len(maps))) as pool:
                aucs = pool.map(inheritable_thread_target(data.sparkSession)(
                    lambda m: ev.evaluate(est.copy(m).fit(train).transform(held))), maps)
        finally:
            train.unpersist()
            held.unpersist()
        total = [t + a for t, a in zip(total, aucs)]
    return [t / n_folds for t in total]


WEIGHT = "_tuning_weight"


def weighted_rows(train: DataFrame, balanced: str | None, scale: float) -> DataFrame:
    """``train`` with the weight column of a setting: balanced n / (2 n_c), times ``scale`` for the positive class."""
    w = F.when(F.col("label") == 1, F.lit(float(scale))).otherwise(F.lit(1.0))
    if balanced == "balanced":
        n = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per class
        total = sum(n.values())
        for y, c in n.items():
            w = F.when(F.col("label") == y, w * F.lit(total / (2.0 * c))).otherwise(w)
    return train.withColumn(WEIGHT, w)


# ---------------------------------------------------------------- MOD4/MOD5
def soft_vote(scored_long: DataFrame, weights: dict[str, float], key: str = "transaction_id",
              model_col: str = "model", prob: str = "fraud_probability") -> DataFrame:
    """Weighted mean of the members' positive-class probabilities (long input: one row per model)."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    s = scored_long.where(F.col(model_col).isin(list(weights)))
    return s.groupBy(key).agg((F.sum(F.col(prob) * w[F.col(model_col)]) / F.sum(w[F.col(model_col)])).alias(prob))


def hard_vote(scored_long: DataFrame, weights: dict[str, float], threshold: float = 0.5, key: str = "transaction_id",
              model_col: str = "model", prob: str = "fraud_probability") -> DataFrame:
    """Weighted majority of the members' 0/1 predictions (ties -> class 0, as argmax of [0, 1] picks 0)."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    s = scored_long.where(F.col(model_col).isin(list(weights)))
    vote1 = F.sum(F.when(F.col(prob) >= threshold, w[F.col(model_col)]).otherwise(0.0))
    vote0 = F.sum(F.when(F.col(prob) < threshold, w[F.col(model_col)]).otherwise(0.0))
    return s.groupBy(key).agg((vote1 > vote0).cast("int").alias("prediction"))


def stacking(base_scores: DataFrame, key: str, label: str, members: Sequence[str], fold_col: str = "fold"):
    """MOD5: meta LogisticRegression on out-of-fold member scores.

    ``base_scores`` holds, per row, each member's score computed by a model
    that did not see the row's fold (columns named after ``members``).
    Returns (meta model, scored DataFrame).
    """
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(members), outputCol="meta_features", handleInvalid="keep")
    d = va.transform(base_scores).withColumn("label", F.col(label).cast("double"))
    meta = LogisticRegression(featuresCol="meta_features", labelCol="label").fit(d)
    out = positive_probability(meta.transform(d), out="stacked_probability")
    return meta, out.select(key, label, fold_col, *members, "stacked_probability")


def score_stack(members: dict[str, Model], meta: Model, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Stacked probability of new rows: scores of the members, fitted on all training rows, through the meta model."""
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(members), outputCol="meta_features", handleInvalid="keep")
    s = meta.transform(va.transform(score_all(members, df, keep)))
    return positive_probability(s, out="stacked_probability").select(*keep, *members, "stacked_probability")


def out_of_fold_scores(df: DataFrame, model_type: str, key: str, k: int, params: dict | None = None,
                       fold_col: str = "fold", out: str | None = None) -> DataFrame:
    """Scores of each row from a model fitted on the other folds (k fits, each one Spark job)."""
    out = out or model_type
    parts = []
    for f in range(k):
        m = create_model(model_type, params).fit(df.where(F.col(fold_col) != f))
        parts.append(score(m, df.where(F.col(fold_col) == f), out=out, keep=[key]))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


# ---------------------------------------------------------------- EVA19
def linear_contributions(df: DataFrame, coefs: dict[str, float], key: str) -> DataFrame:
    """Contribution coef * (x - mean) of every column in ``coefs``, long form per row."""
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(coefs)]).first()
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(float(b)) * (F.col(c) - F.lit(means[f"m{i}"]).cast("double"))).alias(
        "contribution")) for i, (c, b) in enumerate(coefs.items())])
    return df.select(key, F.explode(rows).alias("x")).select(key, "x.feature", "x.contribution")


def linear_attribution(model, df: DataFrame, feature_names: Sequence[str], key: str,
                       features: str = "features") -> DataFrame:
    """Closed-form attribution of a linear model: coef_j * (x_j - mean_j), long form per row."""
    coefs = dict(zip(feature_names, model.coefficients.toArray()))
    arr = vector_to_array(F.col(features))
    return linear_contributions(df.select(key, *[arr[i].alias(n) for i, n in enumerate(feature_names)]), coefs, key)


def permutation_importance(model, df: DataFrame, feature_names: Sequence[str], key: str,
                           label: str = "label", seed: int = SEED) -> DataFrame:
    """EVA19 (re-aimed SHAP summary): AUC drop when one feature's values are permuted across rows.

    The permutation is exact and distributed: rows are ranked twice by
    md5(key || seed) and md5(key || seed+1) (``hash_rank``), and the feature
    value of the row ranked r in the first order is given to the row ranked
    r in the second order (an equi-join on the rank). One scoring job per feature.
    """
    from pyspark.ml.feature import VectorAssembler
    from risklib.operators.evaluate import ranking_metrics
    from risklib.operators.keyed import hash_rank

    arr = vector_to_array(F.col("features"))
    base = df.select(key, F.col(label).alias("true_label"),
                     *[arr[i].alias(f"_f{i}") for i in range(len(feature_names))])
    cols = [f"_f{i}" for i in range(len(feature_names))]
    va = VectorAssembler(inputCols=cols, outputCol="features")

    def auc(d: DataFrame) -> float:
        s = positive_probability(model.transform(va.transform(d)))
        return ranking_metrics(s).first()["roc_auc"]

    ref = auc(base)
    a = hash_rank(base, [], key, seed).withColumnRenamed("hash_rank", "_ra")
    b = hash_rank(base.select(key, *cols), [], key, seed + 1).withColumnRenamed("hash_rank", "_rb")
    rows = []
    for i, name in enumerate(feature_names):
        donor = b.select(F.col("_rb").alias("_ra"), F.col(f"_f{i}").alias("_perm"))
        permuted = a.join(donor, "_ra").withColumn(f"_f{i}", F.col("_perm")).drop("_perm", "_ra")
        rows.append((name, float(ref), float(auc(permuted))))
    spark = df.sparkSession
    out = spark.createDataFrame(rows, "feature string, auc double, auc_permuted double")
    return out.withColumn("importance", F.col("auc") - F.col("auc_permuted"))


def tune_all_models(train: DataFrame, registry, model_types: Sequence[str] = ("logistic", "random_forest", "gradient_boosting"),
                    param_grids: dict | None = None, fold_col: str = "fold", features: Sequence[str] = ()) -> DataFrame:
    """MOD7: tune every model type on the fold column, register each best model with its CV score
    and parameters (the registry row replaces the best-params JSON file), return the score table."""
    spark = train.sparkSession
    n_rows = train.count()  # C -> regParam = 1 / (C * n)
    rows = []
    for t in model_types:
        best, res = tune_hyperparameters(train, t, (param_grids or {}).get(t), fold_col=fold_col, n_rows=n_rows)
        top = res.orderBy(F.desc("roc_auc")).first()
        mid = registry.register_model(best, f"{t}_tuned", t, {"cv_roc_auc": top["roc_auc"]}, list(features),
                                      {"params": top["params"]}, "best of cross-validated search")
        rows.append((t, mid, top["params"], float(top["roc_auc"])))
    return spark.createDataFrame(rows, "model_type string, model_id string, params string, cv_roc_auc double")
