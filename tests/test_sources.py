import os

from pyspark.sql import functions as F

from risklib.operators.features import resolve_timestamp
from risklib.session import scratch_path
from risklib.sources import generate_transactions, read_upload_csv
from risklib.sources.generator import CARD_BRANDS, CITY_STATE, MERCHANT_CATEGORIES


def test_generator_exact_fraud_count_and_domains(spark):
    df = generate_transactions(spark, n_samples=2000, fraud_ratio=0.05, seed=42, num_partitions=4).cache()
    assert df.count() == 2000
    assert df.where("fraud_indicator = 1").count() == int(2000 * 0.05)
    assert df.select("transaction_id").distinct().count() == 2000
    assert {r[0] for r in df.select("merchant_category").distinct().collect()} <= set(MERCHANT_CATEGORIES)
    assert {r[0] for r in df.select("card_brand").distinct().collect()} <= set(CARD_BRANDS)
    pairs = {(r[0], r[1]) for r in df.select("merchant_city", "merchant_state").distinct().collect()}
    assert pairs <= set(CITY_STATE)
    assert df.where(F.col("amount") <= 0).count() == 0
    # deterministic: a second generation gives the same rows
    again = generate_transactions(spark, n_samples=2000, fraud_ratio=0.05, seed=42, num_partitions=4)
    assert df.exceptAll(again).count() == 0


def test_upload_reader_keeps_corrupt_rows(spark):
    path = scratch_path(spark, "upload")
    os.makedirs(path)
    with open(os.path.join(path, "u.csv"), "w") as f:
        f.write("transaction_id,card_number,amount\nTX1,CARD1,10.5\nTX2,CARD2,not-a-number\n")
    from risklib.sources.files import schema_for
    df = read_upload_csv(spark, path, schema_for(["transaction_id", "card_number", "amount"])).collect()
    bad = [r for r in df if r["_corrupt_record"] is not None]
    assert len(df) == 2 and len(bad) == 1 and bad[0]["transaction_id"] == "TX2"


def test_timestamp_source_priority(spark):
    a = spark.createDataFrame([("2024-01-05 10:00:00", "2024-02-01")], "date string, exact_date string")
    assert resolve_timestamp(a).first().transaction_ts.month == 1          # 'date' before 'exact_date'
    b = spark.createDataFrame([("2024-03-07 01:02:03",)], "exact_date string")
    assert resolve_timestamp(b).first().transaction_ts.day == 7
    c = spark.createDataFrame([("2024-01-05", "11:00:00", "2024-09-09")], "transaction_date string, transaction_time string, date string")
    assert resolve_timestamp(c).first().transaction_ts.hour == 11         # date + time before 'date'


def test_api_names_run(spark):
    import datetime as dt
    from risklib import api
    rows = [(i, i % 3, float(10 + i), dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "transaction_id long, card_number long, amount double, transaction_ts timestamp, fraud_indicator int")
    assert api.create_all_advanced_features(df).count() == 30
    assert api.handle_class_imbalance(df, "transaction_id").groupBy("fraud_indicator").count().count() == 2
    sel = api.select_features_univariate(df, ["amount", "card_number"], k=1).collect()
    assert len(sel) == 1
    import pytest
    few = df.where("fraud_indicator = 0 OR transaction_id < 12")
    made = api.handle_class_imbalance(few, "transaction_id", method="smote", cols=["amount"])
    assert {r["count"] for r in made.groupBy("fraud_indicator").count().collect()} == {15}
    with pytest.raises(ValueError):
        api.handle_class_imbalance(df, "transaction_id", method="unknown")


def test_api_calculate_metrics_one_row(spark):
    from risklib import api
    df = spark.createDataFrame([(0.9, 1), (0.2, 0), (0.6, 0), (0.4, 1)], "fraud_probability double, true_label int")
    rows = api.calculate_metrics(df).collect()
    assert len(rows) == 1 and rows[0].roc_auc == 0.75 and rows[0].tp == 1
