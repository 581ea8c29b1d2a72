"""Explicit schemas of the canonical tables (no inference at scale)."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTIONS = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("card_number", T.StringType(), False),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("transaction_date", T.StringType(), True),
    T.StructField("transaction_time", T.StringType(), True),
    T.StructField("transaction_ts", T.TimestampType(), True),
    T.StructField("merchant_id", T.StringType(), False),
    T.StructField("merchant_name", T.StringType(), True),
    T.StructField("merchant_category", T.StringType(), True),
    T.StructField("merchant_city", T.StringType(), True),
    T.StructField("merchant_state", T.StringType(), True),
    T.StructField("payment_method", T.StringType(), True),
    T.StructField("capture_method", T.StringType(), True),
    T.StructField("card_brand", T.StringType(), True),
    T.StructField("issuer_bank", T.StringType(), True),
    T.StructField("issuer_country", T.StringType(), True),
    T.StructField("fraud_indicator", T.IntegerType(), True),
])

REQUIRED_COLUMNS = ["transaction_id", "card_number", "amount"]

# Column names used by the operators (the "canonical" names).
ID, CARD, AMOUNT, TS, LABEL = "transaction_id", "card_number", "amount", "transaction_ts", "fraud_indicator"
PAYMENT_COLUMNS = ["payment_method", "capture_method", "card_brand", "issuer_bank", "issuer_country"]


def numeric_columns(df, exclude=()) -> list[str]:
    """Columns whose Spark type is numeric (the dtype-based choice of the reference)."""
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num) and f.name not in exclude]


def string_columns(df, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]
