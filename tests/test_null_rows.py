"""No operator loses a row because a label or key is null."""

from risklib.operators import evaluate as EV
from risklib.operators import prep as PR
from risklib.operators import select as SE
from risklib.operators.keyed import hash_rank


def frame(spark):
    rows = [(i if i % 13 else None, None if i % 5 == 0 else int(i % 4 == 0), float(i)) for i in range(40)]
    return spark.createDataFrame(rows, "transaction_id long, fraud_indicator int, amount double")


def test_null_labels_and_keys_are_kept(spark):
    df = frame(spark)
    unlabelled = df.where("fraud_indicator is null").count()
    assert hash_rank(df, ["fraud_indicator"], "transaction_id").count() == 40
    s = PR.stratified_split(df, "transaction_id")
    assert s.count() == 40 and s.where("is_test is null").count() == unlabelled
    f = PR.kfold(df, "transaction_id", 3)
    assert f.count() == 40 and f.where("fold is null").count() == unlabelled
    w = PR.class_weights(df)
    assert w.count() == 40 and w.where("weight is null").count() == unlabelled
    o = PR.random_oversample(df, "transaction_id")
    assert o.where("copy = 0").count() == 40
    assert o.where("fraud_indicator = 0").count() == o.where("fraud_indicator = 1").count()
    u = PR.random_undersample(df, "transaction_id")
    assert u.where("fraud_indicator is null").count() == unlabelled
    assert u.where("fraud_indicator = 0").count() == u.where("fraud_indicator = 1").count()
    assert PR.target_encode_oof(f.withColumn("g", df["transaction_id"] % 3), "g").count() == 40


def test_one_class_only(spark):
    df = spark.createDataFrame([(i, 0) for i in range(5)], "transaction_id long, fraud_indicator int")
    assert PR.random_oversample(df, "transaction_id").count() == 5


def test_anova_counts_each_features_own_rows(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, None), (1, 5.0), (1, 7.0)], "fraud_indicator int, x double")
    f = SE.anova_f(df, ["x"]).first()["score"]
    # classes {1, 2} and {5, 7}: between 1 * 4 * 2.25^2, within 0.5 + 2 on 2 degrees
    assert abs(f - 4 * 2.25 ** 2 / (2.5 / 2)) < 1e-9


def test_sweep_compares_with_the_threshold_itself(spark):
    df = spark.createDataFrame([(1, 0.29999999999), (0, 0.3), (1, 0.57)], "true_label int, fraud_probability double")
    sweep = {round(r["threshold"], 2): r for r in EV.threshold_sweep(df).collect()}
    for t in (0.29, 0.3, 0.57, 0.58):
        one = EV.classification_metrics(df, t).first()
        assert (sweep[t]["tp"], sweep[t]["fp"]) == (one["tp"], one["fp"])


def test_psi_without_reference_rows_is_null(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert EV.psi(df, ["x"], F.lit(True)).first()["psi"] is None
