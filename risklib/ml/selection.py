"""Model-based feature selection (SEL6-SEL9): importances, RFE with CV, PCA, combined selector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorSlicer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklib.ml.models import SEED, positive_probability
from risklib.operators.evaluate import ranking_metrics


def model_importance(train: DataFrame, names: Sequence[str], model_type: str = "random_forest",
                     threshold: str | float = "mean") -> DataFrame:
    """SEL6: importances (RF/GBT featureImportances, |coef| for LR) and selection at mean/median/value."""
    if model_type == "logistic":
        m = LogisticRegression(featuresCol="features", labelCol="label").fit(train)
        imp = [abs(float(x)) for x in m.coefficients.toArray()]
    else:
        m = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=50, seed=SEED).fit(train)
        imp = [float(x) for x in m.featureImportances.toArray()]
    spark = train.sparkSession
    t = spark.createDataFrame(list(zip(names, imp)), "feature string, importance double")
    if threshold == "mean":
        cut = t.select(F.avg("importance")).scalar()
    elif threshold == "median":
        cut = t.select(F.median("importance")).scalar()
    else:
        cut = F.lit(float(threshold))
    return t.withColumn("selected", (F.col("importance") >= cut).cast("int"))


def _cv_auc(df: DataFrame, idx: list[int], k: int) -> float:
    sl = VectorSlicer(inputCol="features", outputCol="sub", indices=idx)
    d = sl.transform(df)
    parts = []
    for f in range(k):
        m = LogisticRegression(featuresCol="sub", labelCol="label").fit(d.where(F.col("fold") != f))
        parts.append(positive_probability(m.transform(d.where(F.col("fold") == f))).select(
            F.col("label").alias("true_label"), "fraud_probability", F.lit(f).alias("f")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return ranking_metrics(u, ["f"]).select(F.avg("roc_auc")).first()[0]


def rfe_cv(train: DataFrame, names: Sequence[str], k: int = 5, min_features: int = 5, step: int = 1) -> DataFrame:
    """SEL7: recursive elimination by |LR coefficient| with k-fold ROC AUC at every size.

    Every fit and score is a Spark job; the loop on the driver only carries
    the list of kept feature positions. Needs a ``fold`` column.
    """
    keep = list(range(len(names)))
    rows = []
    while True:
        auc = _cv_auc(train, keep, k)
        rows.append((len(keep), float(auc) if auc is not None else None, ",".join(names[i] for i in keep)))
        if len(keep) <= min_features:
            break
        sl = VectorSlicer(inputCol="features", outputCol="sub", indices=keep).transform(train)
        coef = LogisticRegression(featuresCol="sub", labelCol="label").fit(sl).coefficients.toArray()
        order = sorted(range(len(keep)), key=lambda j: (abs(coef[j]), j))
        drop = set(order[:min(step, len(keep) - min_features)])
        keep = [p for j, p in enumerate(keep) if j not in drop]
    spark: SparkSession = train.sparkSession
    return spark.createDataFrame(rows, "n_features int, roc_auc double, features string")


def pca_reduce(df: DataFrame, n_features: int, n_components: int | None = None, variance_threshold: float = 0.95):
    """SEL8: standardise (mean 0, sd 1) then PCA; k from the cumulative explained variance when not given."""
    sc = StandardScaler(inputCol="features", outputCol="_z", withMean=True, withStd=True).fit(df)
    z = sc.transform(df)
    if n_components is None:
        full = PCA(k=n_features, inputCol="_z", outputCol="pca").fit(z)
        ev = [float(x) for x in full.explainedVariance.toArray()]
        acc, n_components = 0.0, n_features
        for i, v in enumerate(ev):
            acc += v
            if acc >= variance_threshold:
                n_components = i + 1
                break
    model = PCA(k=n_components, inputCol="_z", outputCol="pca").fit(z)
    ev = [float(x) for x in model.explainedVariance.toArray()]
    spark = df.sparkSession
    table = spark.createDataFrame([(i + 1, v, float(sum(ev[:i + 1]))) for i, v in enumerate(ev)],
                                  "component int, explained_variance double, cumulative double")
    return model.transform(z).drop("_z"), table
