"""Advanced risk features (FE2): velocity windows, behaviour, temporal patterns, score.

Per-card frequency maps (hour -> count, weekday -> count, mcc -> count) are
built from pre-aggregated (card, value) counts and joined once per card,
so the row table is shuffled once for all card statistics and a hot card
is a single row of the aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklib.functions.exprs import cut, flag, period_of_day_a, PERIOD_LABELS_PT, weekday
from risklib.operators.features import resolve_timestamp
from risklib.operators.keyed import (HOUR_US, ROWS_PER_PART, attach_stats, fits_time_buckets, probe_counts, range_counts_by_time,
                                     with_range_counts)
from risklib.schema import AMOUNT, CARD, ID, TS

# Weights and thresholds of the composite scores.
RISK_FACTOR_WEIGHTS = {
    "unusual_amount": 0.25,
    "unusual_mcc": 0.15,
    "unusual_hour": 0.20,
    "unusual_day": 0.10,
    "high_risk_time_pattern": 0.15,
    "high_velocity_24h": 0.15,
}
RISK_CATEGORY_LABELS = ["baixo", "medio", "alto", "muito_alto"]
VELOCITY_QUANTILE = 0.95
Z_UNUSUAL = 2.5
MCC_UNUSUAL = 0.1
HOUR_UNUSUAL = 0.05
DAY_UNUSUAL = 0.05


def _has(df, *cols):
    return all(c in df.columns for c in cols)


# ---------------------------------------------------------------- WIN6/WIN7/JN6
def transaction_velocity_features(df: DataFrame, time_windows=(1, 6, 24), key_columns=(CARD,),
                                  bucket_hours: float = 168, method: str = "auto",
                                  rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """tx_count_{w}h = rows of the same key in [t - w h, t) (self and ties excluded),
    high_velocity_{w}h = count > global 95th percentile of that count.

    method "context": (key, bucket) windows with copied look-back rows, one
    shuffle (buckets at least as long as the longest window). method "probe":
    probe rows and prefix sums, buckets of any length (for keys so hot that
    one look-back period of them exceeds a task); see keyed.range_counts_probe.
    method "volume": the same with hot keys cut by their number of rows.
    "auto", the default, takes "volume" when a (key, bucket) holds more than
    ``rows_per_part`` rows and "context" otherwise.
    """
    df = resolve_timestamp(df)
    if TS not in df.columns:
        return df
    ranges = {f"tx_count_{w}h": (-int(w * HOUR_US), -1) for w in time_windows}
    if method == "auto":
        method = "context" if fits_time_buckets(df, key_columns, TS, bucket_hours, rows_per_part) else "volume"
    keys = list(key_columns)
    if method == "volume":
        counts = probe_counts(df, keys, TS, ranges, rows_per_part=rows_per_part)
    elif method == "probe":
        counts = probe_counts(df, keys, TS, ranges, bucket_hours=bucket_hours)
    else:
        counts = range_counts_by_time(df, keys, TS, ranges, bucket_hours)
    # p95 of each count over all rows, from one narrow row per key and time; its buffer is bounded by the number of
    # distinct counts
    untimed = df.where(F.col(TS).isNull()).agg(*[F.lit(0).cast("long").alias(n) for n in ranges], F.count(F.lit(1)).alias("_rows")).where("_rows > 0")
    spread = counts.select(*ranges, "_rows").unionByName(untimed.select(*ranges, "_rows"))
    p95 = spread.agg(*[F.percentile(n, F.lit(VELOCITY_QUANTILE), F.col("_rows")).alias(n) for n in ranges]).first()
    out = with_range_counts(df, keys, TS, counts, list(ranges))
    return out.withColumns({f"high_velocity_{w}h": flag(F.col(f"tx_count_{w}h") > F.lit(p95[f"tx_count_{w}h"]))
                            for w in time_windows})


def _freq_map(df: DataFrame, key: str, value_col, name: str) -> DataFrame:
    """Per card: map value -> count and the total of counted rows (null values excluded)."""
    c = (df.where(value_col.isNotNull()).groupBy(key, value_col.alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    return c.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_v", "_c"))).alias(f"{name}_map"),
                              F.sum("_c").alias(f"{name}_total"))


def _time_maps() -> list:
    """Aggregates of a card: its rows by hour and by weekday as maps, and its rows with a time."""
    def by(value, n):
        return F.map_from_arrays(F.array(*[F.lit(i) for i in range(n)]), F.array(*[F.count_if(value == i) for i in range(n)]))
    return [by(F.hour(TS), 24).alias("_hour_map"), F.count(TS).alias("_hour_total"), by(weekday(TS), 7).alias("__dow_map")]


def card_profile(df: DataFrame, mcc: str = "mcc") -> DataFrame:
    """All card-level statistics of FE2 in one card-keyed table: amount mean/sd and hour / weekday counts from one
    grouped pass, MCC counts (any number of values) from a second on the same key."""
    st = df.groupBy(CARD).agg(F.avg(AMOUNT).alias("_m"), F.stddev_samp(AMOUNT).alias("_sd"), *_time_maps())
    return st.join(_freq_map(df, CARD, F.col(mcc), "_mcc"), CARD, "left") if mcc in df.columns else st


# ---------------------------------------------------------------- AGG10/AGG6/JN3/SCO1
def behavioral_pattern_features(df: DataFrame, mcc: str = "mcc") -> DataFrame:
    df = resolve_timestamp(df)
    if not _has(df, TS, CARD, AMOUNT, mcc):
        return df
    if "_mcc_map" not in df.columns:  # not pre-joined by create_all_advanced_features
        st = df.groupBy(CARD).agg(F.avg(AMOUNT).alias("_m"), F.stddev_samp(AMOUNT).alias("_sd"))
        df = attach_stats(df, st.join(_freq_map(df, CARD, F.col(mcc), "_mcc"), CARD, "left"), [CARD])
    z = F.when(F.col("_sd") > 0, (F.col(AMOUNT) - F.col("_m")) / F.col("_sd")).otherwise(F.lit(0.0))
    freq = F.try_divide(F.try_element_at(F.col("_mcc_map"), F.col(mcc)).cast("double"), F.col("_mcc_total"))
    ua = flag(F.abs(z) > Z_UNUSUAL)
    um = F.when(freq.isNull(), F.lit(1)).otherwise(flag(freq < MCC_UNUSUAL))
    return (df.withColumns({"amount_zscore": z, "unusual_amount": ua, "mcc_frequency": F.coalesce(freq, F.lit(0.0)),
                            "unusual_mcc": um, "behavior_risk_score": ua * 0.6 + um * 0.4})
              .drop("_m", "_sd", "_mcc_map", "_mcc_total"))


# ---------------------------------------------------------------- AGG7/AGG8/JN5/SCO2/SCL10
def temporal_pattern_features(df: DataFrame) -> DataFrame:
    df = resolve_timestamp(df)
    if TS not in df.columns:
        return df
    h = F.hour(TS)
    df = df.withColumns({"hour": h, "day": F.dayofmonth(TS), "day_of_week": weekday(TS),
                         "is_weekend": flag(weekday(TS) >= 5), "period_of_day": period_of_day_a(h, PERIOD_LABELS_PT)})
    if CARD in df.columns:
        if "_hour_map" not in df.columns:  # not pre-joined by create_all_advanced_features
            df = attach_stats(df, df.groupBy(CARD).agg(*_time_maps()), [CARD])
        # the weekday share is divided by the card's hour-count total, as in the reference
        hf = F.try_divide(F.try_element_at("_hour_map", F.col("hour")).cast("double"), F.col("_hour_total"))
        dfq = F.try_divide(F.try_element_at("__dow_map", F.col("day_of_week")).cast("double"), F.col("_hour_total"))
        hfc, dfc = F.coalesce(hf, F.lit(0.0)), F.coalesce(dfq, F.lit(0.0))
        uh, ud = flag(hfc < HOUR_UNUSUAL), flag(dfc < DAY_UNUSUAL)
        df = (df.withColumns({"hour_frequency": hfc, "unusual_hour": uh, "dow_frequency": dfc, "unusual_day": ud,
                              "temporal_risk_score": uh * 0.7 + ud * 0.3})
                .drop("_hour_map", "_hour_total", "__dow_map"))
    return df.withColumn("high_risk_time_pattern",
                         flag(F.col("period_of_day").isin("madrugada", "noite") & (F.col("is_weekend") == 1)))


# ---------------------------------------------------------------- SCO3/SCO4
def fraud_detection_score(df: DataFrame, weights: dict | None = None) -> DataFrame:
    """Weighted 0-100 score over the factor columns present (weights renormalised at plan time)."""
    weights = weights or RISK_FACTOR_WEIGHTS
    avail = [f for f in weights if f in df.columns]
    if not avail:
        return df
    total = sum(weights[f] for f in avail)
    score = None
    for f in avail:
        term = F.col(f) * F.lit(weights[f] / total)
        score = term if score is None else score + term
    # rounded to 6 dp before banding, so a score of exactly 75 is not 75.00000000000001
    sc = F.round(score * 100, 6)
    return df.withColumns({"fraud_risk_score": sc,
                           "risk_category": cut(sc, [0, 25, 50, 75, 100], RISK_CATEGORY_LABELS, include_lowest=True)})


# ---------------------------------------------------------------- FE2
def create_all_advanced_features(df: DataFrame, bucket_hours: int = 168,
                                 rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """velocity -> behaviour -> temporal patterns -> score.

    The row table is shuffled twice: once by (card, time bucket) for the
    velocity windows and once by card for the single card-profile join.
    """
    df = resolve_timestamp(df)
    if not all(c in df.columns for c in (CARD, TS, AMOUNT)):
        df = transaction_velocity_features(df, bucket_hours=bucket_hours, rows_per_part=rows_per_part)
        return fraud_detection_score(temporal_pattern_features(behavioral_pattern_features(df)))
    profile = card_profile(df)            # from the input rows, not from the windowed output
    df = transaction_velocity_features(df, bucket_hours=bucket_hours, rows_per_part=rows_per_part)
    df = attach_stats(df, profile, [CARD])
    df = behavioral_pattern_features(df)
    df = temporal_pattern_features(df)
    return fraud_detection_score(df).drop(*[c for c in df.columns if c.startswith("_")])
