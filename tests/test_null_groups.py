"""Rows without a segment or label in evaluation and selection; range counts with repeated and null ids."""

import pytest
from pyspark.sql import functions as F

from risklib import api
from risklib.operators import advanced as A
from risklib.operators import eda
from risklib.operators import evaluate as EV
from risklib.operators import features as FE
from risklib.operators import select as SE

SCORED = [("a", 1, 0.9), ("a", 0, 0.2), (None, 1, 0.8), (None, 0, 0.9), (None, 0, 0.1)]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(SCORED, "segment string, true_label int, fraud_probability double")


def test_a_null_segment_is_a_segment(scored):
    named = scored.withColumn("segment", F.coalesce("segment", F.lit("none")))

    def table(df, fn):
        out = fn(df)
        return sorted((tuple("none" if (c == "segment" and r[c] is None) else r[c] for c in sorted(out.columns)) for r in out.collect()), key=str)

    for fn in (lambda d: EV.segment_metrics(d, "segment"), lambda d: EV.ranking_metrics(d, ["segment"]), lambda d: EV.roc_points(d, ["segment"]),
               lambda d: EV.pr_points(d, ["segment"]), lambda d: EV.threshold_sweep(d, ["segment"]), lambda d: EV.compare_models(d, "segment"),
               lambda d: EV.optimal_thresholds(EV.threshold_sweep(d, ["segment"]), ["segment"]),
               lambda d: EV.min_cost_threshold(EV.threshold_sweep(d, ["segment"]), ["segment"]), lambda d: api.calculate_metrics(d, 0.5, ["segment"])):
        assert table(scored, fn) == table(named, fn)
    assert {r["segment"]: r["count"] for r in EV.segment_metrics(scored, "segment").collect()} == {"a": 2, None: 3}


def test_null_labels_in_confusion_and_box_numbers(spark):
    df = spark.createDataFrame([(1, 0.9, 5.0), (0, 0.1, 7.0), (None, 0.6, 9.0), (None, 0.2, 11.0)], "true_label int, fraud_probability double, x double")
    got = {(r["true_label"], r["predicted"]): r["share"] for r in EV.normalized_confusion(df).collect()}
    assert got == {(1, 1): 1.0, (0, 0): 1.0, (None, 1): 0.5, (None, 0): 0.5}
    box = {r["true_label"]: r["median"] for r in eda.box_stats(df, "x", "true_label").collect()}
    assert box == {1: 5.0, 0: 7.0, None: 10.0}


def test_unlabelled_rows_do_not_change_selection_scores(spark):
    rows = [(i % 2, float(i), float(i * i % 7)) for i in range(30)]
    df = spark.createDataFrame(rows, "fraud_indicator int, x double, z double")
    more = df.unionByName(spark.createDataFrame([(None, 1000.0, 3.0), (None, None, None)], df.schema))
    for fn in (SE.chi2, SE.mutual_information, SE.anova_f):
        assert sorted(map(tuple, fn(df, ["x", "z"]).collect())) == sorted(map(tuple, fn(more, ["x", "z"]).collect()))


def test_range_counts_by_all_methods_on_repeated_and_null_ids(spark):
    hours = [(1, 7, 0), (1, 7, 5), (None, 7, 1), (None, 7, 2), (3, 7, 3), (4, 8, 3), (4, 8, 3), (5, None, 3), (6, None, 4), (9, 7, None)]
    df = spark.createDataFrame([(i, c, h) for i, c, h in hours], "transaction_id long, card_number long, h int")
    df = df.select("transaction_id", "card_number", F.lit(10.0).alias("amount"),
                   F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h)").alias("transaction_ts"), "h")
    seen = {}
    for method in ("context", "probe", "volume"):
        v = A.transaction_velocity_features(df, method=method, rows_per_part=2)
        seen[method] = sorted(((r["card_number"], r["h"], r["tx_count_1h"], r["tx_count_6h"], r["tx_count_24h"]) for r in v.collect()), key=str)
        assert len(seen[method]) == len(hours)
        c = FE.add_card_context(df, method=method, rows_per_part=2)
        col = next(x for x in c.columns if x.endswith("cnt24_incl"))
        seen[method + "24"] = sorted(((r["card_number"], r["h"], r[col]) for r in c.collect()), key=str)
    assert seen["context"] == seen["probe"] == seen["volume"]
    assert seen["context24"] == seen["probe24"] == seen["volume24"]
    assert [r[4] for r in seen["context"] if r[0] == 7 and r[1] is not None] == [0, 1, 2, 3, 4]


def test_one_hot_refuses_columns_of_ids(spark):
    df = spark.range(2000).select(F.concat(F.lit("TX"), F.col("id").cast("string")).alias("t"), (F.col("id") % 3).cast("string").alias("g"))
    with pytest.raises(ValueError):
        api.encode_categorical_features(df, "onehot")
    assert set(api.encode_categorical_features(df, "onehot", ["g"]).columns) == {"t", "g_0", "g_1", "g_2"}


def test_label_codes_of_values_with_one_prefix(spark):
    df = spark.range(500).select(F.format_string("TX%05d", "id").alias("t"))
    assert [r["t"] for r in api.encode_categorical_features(df, "label").orderBy("t").collect()] == list(range(500))
