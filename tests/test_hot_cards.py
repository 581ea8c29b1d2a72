"""A card with a third of the rows inside one hour: results stay exact and no window group takes its rows whole."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from risklib.operators import advanced as A
from risklib.operators import features as FT
from risklib.operators.eda import customer_history
from risklib.operators.keyed import cut_by_volume, fits_time_buckets

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)
LIMIT = 40


@pytest.fixture(scope="module")
def tx(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(900):
        hot = i % 3 == 0
        ts = T0 + (dt.timedelta(seconds=rnd.randint(0, 3599)) if hot else dt.timedelta(minutes=rnd.randint(0, 20_000)))
        card = 1 if hot else None if i % 50 == 1 else rnd.randint(2, 20)
        rows.append((i, card, round(rnd.uniform(0, 99), 2), None if i % 41 == 0 else ts, i % 2, i % 7))
    return spark.createDataFrame(rows, "transaction_id long, card_number long, amount double, transaction_ts timestamp, "
                                       "fraud_indicator int, mcc int").repartition(4).cache()


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_parts_are_bounded_and_follow_time(tx):
    assert not fits_time_buckets(tx, ["card_number"], "transaction_ts", 168, LIMIT)
    u = cut_by_volume(tx.withColumn("_us", F.unix_micros("transaction_ts")), ["card_number"], "_us", LIMIT)
    parts = u.where("_us IS NOT NULL").groupBy("card_number", "_b").agg(
        F.count("*").alias("n"), F.min("_us").alias("lo"), F.max("_us").alias("hi")).collect()
    assert max(p.n for p in parts) <= 1.5 * LIMIT
    hot = sorted((p._b, p.lo, p.hi) for p in parts if p.card_number == 1)
    assert len(hot) >= 300 / LIMIT - 1
    assert all(a[2] < b[1] for a, b in zip(hot, hot[1:]))
    assert u.where("_us IS NULL AND _b IS NOT NULL").count() == 0 and u.count() == 900


def test_features_do_not_depend_on_the_cut(tx):
    same(A.create_all_advanced_features(tx, rows_per_part=LIMIT), A.create_all_advanced_features(tx))
    same(FT.create_all_features(tx, rows_per_part=LIMIT), FT.create_all_features(tx))
    same(customer_history(tx, rows_per_part=LIMIT), customer_history(tx))


def test_rows_without_a_time_are_first_only_in_cards_without_times(spark):
    df = spark.createDataFrame([(1, 1, 1.0, T0), (2, 1, 2.0, None), (3, 2, 1.0, None), (4, 2, 1.0, None)],
                               "transaction_id long, card_number long, amount double, transaction_ts timestamp")
    got = {r.transaction_id: r.is_first_transaction for r in FT.customer_behavior_features(df).collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0}


def test_missing_columns_skip(spark):
    df = spark.createDataFrame([(1, 1.0)], "card_number long, amount double")
    assert FT.customer_behavior_features(df).columns == df.columns
    assert "amount_ratio_to_previous" not in FT.fraud_pattern_features(df).columns
