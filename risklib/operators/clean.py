"""Cleaning (CLN1-CLN4, CLN8) and the pipeline's row extractors (SCL3, SCL7, SCL9, AGG11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklib.functions.exprs import cut, flag, period_of_day_b, weekday
from risklib.functions.fitted import fit_row, lit, most_frequent
from risklib.operators.features import AMOUNT_EDGES_5, AMOUNT_LABELS_5, resolve_timestamp
from risklib.operators.quantiles import fit_quantiles
from risklib.schema import AMOUNT, CARD, ID, LABEL, TS, numeric_columns, string_columns


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """CLN1: absent names are ignored."""
    return df.drop(*cols)


def impute(df: DataFrame, numeric: Sequence[str] | None = None, strings: Sequence[str] | None = None,
           exclude: Sequence[str] = ()) -> DataFrame:
    """CLN2/CLN3: exact median for numeric columns, most frequent value (ties -> smallest) for strings.

    Medians and most frequent values come from grouped counts of the values, whatever the column count.
    """
    numeric = [c for c in (numeric if numeric is not None else numeric_columns(df)) if c not in exclude]
    strings = [c for c in (strings if strings is not None else string_columns(df)) if c not in exclude]
    if not numeric and not strings:
        return df
    medians = fit_quantiles(df, numeric, [0.5])
    top = most_frequent(df, strings)
    types = dict(df.dtypes)
    out = []
    for c in df.columns:
        if c in numeric:
            out.append(F.coalesce(F.col(c), F.lit((medians[c] or [None])[0]).cast(types[c])).alias(c))
        elif c in strings:
            out.append(F.coalesce(F.col(c), F.lit(top[c]).cast("string")).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def clean_data(df: DataFrame, drop: Sequence[str] = (), target: str = LABEL) -> DataFrame:
    """CLN1 + CLN2 + CLN3 + CLN4: drop, impute, combine date/time into ``transaction_ts``.

    Transaction and card ids are never imputed: a made-up id would join rows that do not belong together.
    """
    df = drop_columns(df, drop)
    df = impute(df, exclude=[target, ID, CARD])
    return resolve_timestamp(df)


def null_summary(df: DataFrame) -> DataFrame:
    """CLN8: column, type, non-null and null counts (one aggregate, unpivoted)."""
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"c{i}").alias("non_null"))
                               for i, (c, t) in enumerate(df.dtypes)])).alias("r")
    return one.select("__n", rows).select("r.column", "r.dtype", "r.non_null",
                                          (F.col("__n") - F.col("r.non_null")).alias("nulls"))


def datetime_extractor(df: DataFrame) -> DataFrame:
    """SCL4/SCL5/SCL7: hour, day, month, weekday, weekend flag, period of day (variant B)."""
    df = resolve_timestamp(df)
    if TS not in df.columns:
        return df
    return (df.withColumn("hour", F.hour(TS)).withColumn("day", F.dayofmonth(TS)).withColumn("month", F.month(TS))
              .withColumn("day_of_week", weekday(TS))
              .withColumn("is_weekend", flag(F.col("day_of_week") >= 5))
              .withColumn("period_of_day_b", period_of_day_b("hour")))


def custom_extractor(df: DataFrame) -> DataFrame:
    """SCL3/AGG11/SCL9: 5-band amount, global z-score (sample sd), outlier flag, weekend early-morning flag."""
    if AMOUNT in df.columns:
        st = fit_row(df, F.avg(AMOUNT).alias("m"), F.stddev_samp(AMOUNT).alias("s"))
        df = (df.withColumn("amount_band5", cut(AMOUNT, AMOUNT_EDGES_5, AMOUNT_LABELS_5))
                .withColumn("amount_zscore_global", F.try_divide(F.col(AMOUNT) - lit(st["m"]), lit(st["s"])))
                .withColumn("is_amount_outlier", flag(F.abs("amount_zscore_global") > 3)))
    if "is_weekend" in df.columns and "period_of_day_b" in df.columns:
        df = df.withColumn("high_risk_time", flag((F.col("is_weekend") == 1) & (F.col("period_of_day_b") == "early_morning")))
    return df


