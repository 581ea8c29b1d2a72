import datetime as dt

from pyspark.sql import functions as F

from risklib.operators import scores as SCO

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def test_reason_codes_sorted_by_abs_weight_ties_by_name(spark):
    df = spark.createDataFrame([(1,)], "transaction_id long")
    contrib = {"b": F.lit(0.2), "a": F.lit(0.2), "c": F.lit(-0.5), "d": F.lit(0.1), "e": F.lit(0.3), "f": F.lit(-0.05)}
    r = SCO.reason_codes(df, contrib).first()
    assert r.top_positive == "e|a|b"          # |0.3| first, then the 0.2 tie by name; top 3 only
    assert r.top_negative == "c|f"


def test_new_merchant_flag_ties_by_id(spark):
    rows = [(1, 7, 5.0, T0, "m1"), (2, 7, 5.0, T0, "m1"), (3, 7, 5.0, T0 + dt.timedelta(hours=1), "m2"),
            (4, 8, 5.0, T0, "m1")]
    df = spark.createDataFrame(rows, "transaction_id long, card_number long, amount double, transaction_ts timestamp, merchant_id string")
    got = {r.transaction_id: r.is_new_merchant for r in SCO.new_merchant_flag(df, "merchant_id").collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 1}


def test_rule_score_cap_and_threshold(spark):
    rows = [(1, 1, 5000.0, T0.replace(hour=3)), (2, 1, 10.0, T0)]
    df = spark.createDataFrame(rows, "transaction_id long, card_number long, amount double, transaction_ts timestamp")
    out = {r.transaction_id: r for r in SCO.rule_score(df, 0.35, international=F.lit(True)).collect()}
    assert abs(out[1].fraud_probability - (0.05 + 0.15 * 3)) < 1e-12 and out[1].is_fraud == 1
    assert abs(out[2].fraud_probability - 0.2) < 1e-12 and out[2].is_fraud == 0
