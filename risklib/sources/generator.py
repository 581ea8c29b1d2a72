"""SRC4: synthetic transactions generated as a distributed Spark job.

Each row is a pure function of (row id, seed) through rand/randn with fixed
seeds, so the job is parallel and a lost partition recomputes the same rows.
The fraud rows are the last ``int(n * fraud_ratio)`` ids, as in the original
generator; ids are then the only ordering (no global shuffle of rows).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the original generator (domains of the synthetic table).
MERCHANT_CATEGORIES = ["Retail", "Food", "Entertainment", "Travel", "Services", "Other"]
CITY_STATE = [("New York", "NY"), ("Los Angeles", "CA"), ("Chicago", "IL"), ("Houston", "TX"),
              ("Phoenix", "AZ"), ("Philadelphia", "PA"), ("San Antonio", "TX"), ("San Diego", "CA"),
              ("Dallas", "TX"), ("San Jose", "CA"), ("Austin", "TX"), ("Jacksonville", "FL"),
              ("Fort Worth", "TX"), ("Columbus", "OH"), ("Charlotte", "NC"), ("San Francisco", "CA"),
              ("Indianapolis", "IN"), ("Seattle", "WA")]
PAYMENT_METHODS = ["Credit", "Debit", "ACH", "Wire Transfer"]
CAPTURE_METHODS = ["Chip", "Swipe", "Manual Entry", "Online", "Contactless"]
CAPTURE_P_LEGIT = [0.4, 0.2, 0.1, 0.2, 0.1]
CAPTURE_P_FRAUD = [0.1, 0.1, 0.4, 0.3, 0.1]
CARD_BRANDS = ["Visa", "Mastercard", "Amex", "Discover"]
ISSUERS = [("Bank of America", "USA"), ("Chase", "USA"), ("Wells Fargo", "USA"), ("Citibank", "USA"),
           ("Capital One", "USA"), ("US Bank", "USA"), ("PNC Bank", "USA"), ("TD Bank", "USA"),
           ("Truist Bank", "USA"), ("HSBC", "UK")]
N_CARDS, N_MERCHANTS, N_MERCHANT_NAMES = 5000, 1000, 500


def _pick(u: Column, values: list, probs: list | None = None) -> Column:
    """Weighted choice by a cumulative ``when`` chain on a uniform draw."""
    probs = probs or [1.0 / len(values)] * len(values)
    expr, acc = None, 0.0
    for v, p in zip(values[:-1], probs[:-1]):
        acc += p
        expr = F.when(u < acc, F.lit(v)) if expr is None else expr.when(u < acc, F.lit(v))
    return expr.otherwise(F.lit(values[-1]))


def _idx(u: Column, n: int) -> Column:
    return F.least(F.floor(u * n), F.lit(n - 1)).cast("int")


def generate_transactions(spark: SparkSession, n_samples: int = 10000, fraud_ratio: float = 0.05,
                          seed: int = 42, base_date: str = "2024-01-01",
                          num_partitions: int | None = None) -> DataFrame:
    n_fraud = int(n_samples * fraud_ratio)
    n_legit = n_samples - n_fraud
    base = _dt.datetime.fromisoformat(base_date)
    df = spark.range(1, n_samples + 1, numPartitions=num_partitions).withColumn(
        "is_fraud", (F.col("id") > n_legit).cast("int"))
    r = lambda k: F.rand(seed + k)
    legit_amt = F.exp(F.lit(4.0) + F.randn(seed + 1))
    fraud_small = F.exp(F.lit(3.0) + F.lit(1.5) * F.randn(seed + 2))
    fraud_large = F.exp(F.lit(6.0) + F.lit(2.0) * F.randn(seed + 3))
    n_small = int(n_fraud * 0.7)
    amount = F.when(F.col("is_fraud") == 0, legit_amt).when(
        F.col("id") - n_legit <= n_small, fraud_small).otherwise(fraud_large)
    offset_s = (_idx(r(4), 30) * 86400 + _idx(r(5), 24) * 3600 + _idx(r(6), 60) * 60 + _idx(r(7), 60))
    ts = (F.lit(base).cast("timestamp") + F.make_dt_interval(secs=offset_s.cast("decimal(18,6)")))
    city_idx = _idx(r(8), len(CITY_STATE))
    issuer_idx = _idx(r(9), len(ISSUERS))
    cities = F.array(*[F.lit(c) for c, _ in CITY_STATE])
    states = F.array(*[F.lit(s) for _, s in CITY_STATE])
    banks = F.array(*[F.lit(b) for b, _ in ISSUERS])
    countries = F.array(*[F.lit(c) for _, c in ISSUERS])
    capture = F.when(F.col("is_fraud") == 0, _pick(r(10), CAPTURE_METHODS, CAPTURE_P_LEGIT)).otherwise(
        _pick(r(10), CAPTURE_METHODS, CAPTURE_P_FRAUD))
    out = df.select(
        F.format_string("TX%010d", "id").alias("transaction_id"),
        F.format_string("CARD%08d", _idx(r(11), N_CARDS)).alias("card_number"),
        F.round(amount, 2).alias("amount"),
        ts.alias("transaction_ts"),
        F.format_string("MERCH%06d", _idx(r(12), N_MERCHANTS)).alias("merchant_id"),
        F.format_string("Merchant %d", _idx(r(13), N_MERCHANT_NAMES) + 1).alias("merchant_name"),
        _pick(r(14), MERCHANT_CATEGORIES).alias("merchant_category"),
        F.element_at(cities, city_idx + 1).alias("merchant_city"),
        F.element_at(states, city_idx + 1).alias("merchant_state"),
        _pick(r(15), PAYMENT_METHODS).alias("payment_method"),
        capture.alias("capture_method"),
        _pick(r(16), CARD_BRANDS).alias("card_brand"),
        F.element_at(banks, issuer_idx + 1).alias("issuer_bank"),
        F.element_at(countries, issuer_idx + 1).alias("issuer_country"),
        F.col("is_fraud").alias("fraud_indicator"),
    )
    return out.select(
        "transaction_id", "card_number", "amount",
        F.date_format("transaction_ts", "yyyy-MM-dd").alias("transaction_date"),
        F.date_format("transaction_ts", "HH:mm:ss").alias("transaction_time"),
        *[c for c in out.columns if c not in ("transaction_id", "card_number", "amount")])
