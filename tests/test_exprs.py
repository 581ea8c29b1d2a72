import math

from pyspark.sql import functions as F

from risklib.functions.exprs import cut, flag, period_of_day_a, period_of_day_b, safe_div
from risklib.operators.features import AMOUNT_EDGES_6, AMOUNT_LABELS_6


def test_band_edges_right_closed_zero_is_null(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 10.0, 50.0, 100.0, 500.0, 1000.0, 1001.0, -1.0]], "x double")
    out = {r.x: r.b for r in df.select("x", cut("x", AMOUNT_EDGES_6, AMOUNT_LABELS_6).alias("b")).collect()}
    assert out[0.0] is None and out[-1.0] is None
    assert out[10.0] == "very_small" and out[50.0] == "small" and out[100.0] == "medium"
    assert out[500.0] == "large" and out[1000.0] == "very_large" and out[1001.0] == "huge"


def test_hour_edges_two_variants(spark):
    df = spark.createDataFrame([(h,) for h in [0, 6, 7, 12, 18, 22, 23]] + [(None,)], "h int")
    got = {r.h: (r.a, r.b) for r in df.select("h", period_of_day_a("h").alias("a"), period_of_day_b("h").alias("b")).collect()}
    assert got[0] == ("early_morning", "early_morning")
    assert got[6] == ("early_morning", "morning")
    assert got[7] == ("morning", "morning")
    assert got[12] == ("morning", "afternoon")
    assert got[18] == ("afternoon", "night")
    assert got[22] == ("evening", "night") and got[23] == ("evening", "night")
    assert got[None] == (None, "night")


def test_flag_null_is_zero_and_safe_div(spark):
    df = spark.createDataFrame([(None, 0.0), (1.0, 0.0), (4.0, 2.0)], "a double, b double")
    r = df.select(flag(F.col("a") > 0).alias("f"), safe_div("a", "b").alias("d")).collect()
    assert [x.f for x in r] == [0, 1, 1]
    assert r[0].d is None and r[1].d is None and math.isclose(r[2].d, 2.0)


def test_feature_tagging_multi_label_and_other(spark):
    from risklib.operators.eda import FEATURE_KEYWORDS_PAGE, tag_features
    cat = spark.createDataFrame([("amount_per_day",), ("merchant_risk",), ("is_weekend",)], "feature string")
    got = {(r.feature, r.category) for r in tag_features(cat, rules=FEATURE_KEYWORDS_PAGE, lowercase=True, other="Other").collect()}
    assert got == {("amount_per_day", "Temporal"), ("amount_per_day", "Value"), ("merchant_risk", "Location"),
                   ("is_weekend", "Other")}
