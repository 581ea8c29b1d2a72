"""Saved pipelines and distinct counts by sketches."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from risklib.ml import stages as ST
from risklib.operators import distinct as DI
from risklib.session import scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, float(i % 17) if i % 9 else None, ("p", "q", None)[i % 3], 1 if i % 6 == 0 else 0 if i % 29 else None) for i in range(240)]
    return spark.createDataFrame(data, "transaction_id long, x double, g string, fraud_indicator int")


@pytest.mark.parametrize("balance", ["none", "random", "smote", "adasyn", "undersample"])
def test_pipelines_save_and_load_fitted_and_unfitted(spark, rows, balance):
    p = ST.training_pipeline(LogisticRegression(maxIter=5), ["x"], ["g"], balance)
    path = scratch_path(spark, "t-pipeline")
    p.write().save(path)
    again = Pipeline.load(path)
    assert again.getStages()[1].getOrDefault("method") == balance and again.getStages()[1].classifier.getMaxIter() == 5
    scores = []
    for q in (p, again):
        m = q.fit(rows)
        to = scratch_path(spark, "t-model")
        m.write().save(to)
        for one in (m, PipelineModel.load(to)):
            scores.append(sorted(tuple(r) for r in ST.score_rows(one, rows).select("transaction_id", "fraud_probability", "is_fraud").collect()))
            assert one.stages[0].names == ["x", "g_p", "g_q"]
    assert all(s == scores[0] for s in scores) and len(scores[0]) == 240


def test_balancing_acts_in_fitting_only(spark, rows):
    m = ST.training_pipeline(LogisticRegression(), ["x"], ["g"], "random").fit(rows)
    assert m.transform(rows).count() == 240 and m.transform(rows.drop("fraud_indicator")).count() == 240
    prepared = ST.Preparation(numerical=["x"], categorical=["g"]).fit(rows).transform(rows).where("label is not null")
    even = ST.BalancedClassifier(LogisticRegression(), "smote").balanced(prepared)
    counts = {r["label"]: r["count"] for r in even.groupBy("label").count().collect()}
    assert counts[0.0] == counts[1.0]
    with pytest.raises(ValueError):
        ST.BalancedClassifier(LogisticRegression(), "unknown")


def test_preparation_of_unseen_and_missing_values(spark, rows):
    m = ST.Preparation(numerical=["x"], categorical=["g"]).fit(rows)
    new = spark.createDataFrame([(1, None, "zzz"), (2, 1e9, None)], "transaction_id long, x double, g string")
    out = {r["transaction_id"]: r["v"] for r in m.transform(new).select("transaction_id", vector_to_array("features").alias("v")).collect()}
    assert out[1][1:] == [0.0, 0.0] and sum(out[2][1:]) == 1.0 and len(out[1]) == 3


def test_distinct_counts_are_exact_below_the_limit_and_close_beyond(spark):
    df = spark.range(40_000).select(
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 10 as int))").alias("transaction_ts"),
        (F.col("id") % 30_000).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("b"))
    df = df.unionByName(spark.createDataFrame([(None, 5, 900), (None, 6, 901)], df.schema))
    daily = DI.daily_distinct(df, ["a", "b"], limit=1000)
    out = {r["column"]: r for r in DI.distinct_counts(daily, F.lit("all"), limit=1000).collect()}
    assert (out["b"]["n_distinct"], out["b"]["exact"]) == (9, 1)
    assert out["a"]["exact"] == 0 and abs(out["a"]["n_distinct"] - 30_000) < 600
    by_day = {(r["period"], r["column"]): r for r in DI.distinct_counts(daily, F.col("day"), limit=1000).collect()}
    assert by_day[None, "b"]["n_distinct"] == 2 and len(by_day) == 20  # on two days every b is null
    wide = DI.distinct_counts(DI.daily_distinct(df, ["a", "b"], limit=100_000), F.lit("all"), limit=100_000).collect()
    assert {r["column"]: (r["n_distinct"], r["exact"]) for r in wide} == {"a": (30_000, 1), "b": (9, 1)}
    empty = DI.daily_distinct(df.where("a < 0"), ["a"])
    assert DI.distinct_counts(empty, F.lit("all")).count() == 0
