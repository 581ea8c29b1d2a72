"""Basic risk features (FE1 and its parts).

Column names are the canonical snake_case names of ``risklib.schema``.
Every function checks for its input columns on ``df.columns`` at plan
time and returns the input unchanged when they are absent (the reference's
skip policy). Card-level context (previous row, 24 h count, card stats) is
computed once by ``add_card_context`` and reused by the later functions
when present, so ``create_all_features`` needs one card-keyed sequence
stage and one card-keyed stats join.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklib.functions.exprs import cut, cyclic_distance, flag, period_of_day_a, safe_div, weekday
from risklib.operators.keyed import (HOUR_US, ROWS_PER_PART, attach_stats, fits_time_buckets, range_counts_probe,
                                     sequence_stage, stats_once, written)
from risklib.operators.quantiles import weighted_quantiles
from risklib.schema import AMOUNT, CARD, ID, LABEL, PAYMENT_COLUMNS, TS

# Band edges and labels.
AMOUNT_EDGES_6 = [0, 10, 50, 100, 500, 1000, math.inf]
AMOUNT_LABELS_6 = ["very_small", "small", "medium", "large", "very_large", "huge"]
AMOUNT_EDGES_5 = [0, 50, 100, 500, 1000, math.inf]
AMOUNT_LABELS_5 = ["very_low", "low", "medium", "high", "very_high"]
RISK_LABELS_4 = ["low_risk", "medium_low_risk", "medium_high_risk", "high_risk"]
LOCATION_FALLBACK_EDGES = [0, 0.01, 0.05, 0.10, 1.0]
QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]
NO_PREVIOUS_MINUTES = 99999
QUICK_MINUTES = 30
HOME_COUNTRY = "USA"

CTX_PREFIX = "_ctx_"


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as Parquet in the shared checkpoint folder and read them back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing
    the upstream joins) and keeps vectorised, column-pruned Parquet scans
    for every branch that reads the table.
    """
    from risklib.session import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# ---------------------------------------------------------------- CLN4/CLN5
def resolve_timestamp(df: DataFrame, out: str = TS) -> DataFrame:
    """Pick the event time from the first available source, bad strings -> null."""
    if out in df.columns:
        if dict(df.dtypes)[out] in ("timestamp", "timestamp_ntz"):
            return df.withColumn(out, F.col(out).cast("timestamp"))
        return df.withColumn(out, F.try_to_timestamp(F.col(out).cast("string")))
    if _has(df, "transaction_date", "transaction_time"):
        s = F.when(F.col("transaction_date").isNotNull() & F.col("transaction_time").isNotNull(),
                   F.concat_ws(" ", "transaction_date", "transaction_time"))
        return df.withColumn(out, F.try_to_timestamp(s))
    for alt in ("date", "exact_date"):
        if alt in df.columns:
            return df.withColumn(out, F.try_to_timestamp(F.col(alt).cast("string")))
    return df


# ---------------------------------------------------------------- SCL1/SCL2
def amount_features(df: DataFrame) -> DataFrame:
    if AMOUNT not in df.columns:
        return df
    return (df.withColumn("amount_log", F.log1p(AMOUNT))
              .withColumn("amount_category", cut(AMOUNT, AMOUNT_EDGES_6, AMOUNT_LABELS_6)))


# ---------------------------------------------------------------- SCL4-SCL8
def temporal_features(df: DataFrame) -> DataFrame:
    df = resolve_timestamp(df)
    if TS not in df.columns:
        return df
    h = F.hour(TS)
    return df.withColumns({"hour_of_day": h, "day_of_week": weekday(TS), "is_weekend": flag(weekday(TS).isin(5, 6)),
                           "month": F.month(TS), "day_of_month": F.dayofmonth(TS), "period_of_day": period_of_day_a(h),
                           "is_night_time": flag(((h >= 0) & (h < 6)) | (h >= 22))})


# ---------------------------------------------------------------- AGG1/AGG2/WIN10/WIN11
def rate_stats(rows: DataFrame, columns) -> dict[str, DataFrame]:
    """Per column: (value, _s: fraud rows, _n: labelled rows, _rows: rows) of every value, from one pass over the rows."""
    return stats_once(rows, columns, [F.sum(F.col(LABEL).cast("long")).alias("_s"), F.count(LABEL).alias("_n"),
                                      F.count(F.lit(1)).alias("_rows")], "rates")


def _rate_table(stats: DataFrame, key: str, min_count: int, rate_name: str, global_mean) -> DataFrame:
    """Per key: the rate where it has ``min_count`` labelled rows, the global one elsewhere; and the key's rows."""
    rate = F.when(F.col(key).isNotNull() & (F.col("_n") >= min_count), F.col("_s") / F.col("_n"))
    return stats.select(key, "_rows", F.coalesce(rate, F.lit(global_mean).cast("double")).alias(rate_name))


def _quartile_edges(stats: DataFrame, rate_col: str) -> list:
    """Row-weighted quartile edges of a per-group rate."""
    return weighted_quantiles(stats, rate_col, "_rows", QUARTILES) or [None] * 5


def _qcut4_or_fixed(rate_col: str, stats: DataFrame) -> "F.Column":
    """qcut(rate, quartiles) over rows; when an edge repeats, fixed edges (as the reference's fallback).

    The edges are fitted from the (small) per-group table and bound as
    literals, so the branch is chosen once, at plan time.
    """
    e = _quartile_edges(stats, rate_col)
    if all(x is not None for x in e) and all(e[i] < e[i + 1] for i in range(4)):
        return cut(rate_col, e, RISK_LABELS_4, include_lowest=True)
    return cut(rate_col, LOCATION_FALLBACK_EDGES, RISK_LABELS_4)


def location_features(df: DataFrame, city: str = "merchant_city", state: str = "merchant_state",
                      city_min: int = 5, state_min: int = 10, rates: dict[str, DataFrame] | None = None) -> DataFrame:
    """Fraud rate and risk band of city and state; ``rates``: from ``rate_stats`` (default: of ``df``)."""
    if not _has(df, city, state):
        return df
    if LABEL in df.columns:
        rates = rates or rate_stats(df, [city, state])
        total = rates[state].agg(F.sum("_s").alias("s"), F.sum("_n").alias("n")).first()
        global_mean = total["s"] / total["n"] if total["n"] else None
        cs = _rate_table(rates[city], city, city_min, "city_fraud_rate", global_mean)
        cs = cs.withColumn("city_risk_category", _qcut4_or_fixed("city_fraud_rate", cs)).drop("_rows")
        ss = _rate_table(rates[state], state, state_min, "state_fraud_rate", global_mean)
        ss = ss.withColumn("state_risk_category", _qcut4_or_fixed("state_fraud_rate", ss)).drop("_rows")
        df = attach_stats(attach_stats(df, cs, [city], null_safe=True), ss, [state], null_safe=True)
    if _has(df, "customer_zip", "merchant_zip"):
        a, b = F.col("customer_zip"), F.col("merchant_zip")
        # null != null is true for pandas objects, so both-null also counts as different
        df = df.withColumn("different_zip", (~a.eqNullSafe(b) | (a.isNull() & b.isNull())).cast("int"))
    if "city_risk_category" in df.columns:
        df = df.withColumn("high_risk_location", flag(F.col("city_risk_category") == "high_risk"))
    return df


# ---------------------------------------------------------------- card context
def add_card_context(df: DataFrame, windows_excl_hours=(), bucket_hours: float = 168,
                     method: str = "auto", rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Previous row, 24 h inclusive count, [t-w, t) counts and card stats, in one pass.

    Adds columns prefixed ``_ctx_``; later feature functions reuse them.
    ``method="probe"`` computes the range counts with probe rows
    (``keyed.range_counts_probe``) and the previous row with context-free
    buckets, so ``bucket_hours`` may be shorter than the 24 h look-back
    (for cards too hot for one look-back period per task). "volume" cuts
    hot cards by their number of rows; "auto", the default, takes it when a
    (card, time bucket) holds more than ``rows_per_part`` rows and
    "context" otherwise.
    """
    if not _has(df, CARD) or f"{CTX_PREFIX}cnt" in df.columns:
        return df
    df = resolve_timestamp(df)
    aggs = [F.count(ID).alias(f"{CTX_PREFIX}cnt") if ID in df.columns else F.count(F.lit(1)).alias(f"{CTX_PREFIX}cnt"),
            F.count(F.lit(1)).alias(f"{CTX_PREFIX}rows")]
    if AMOUNT in df.columns:
        aggs += [F.avg(AMOUNT).alias(f"{CTX_PREFIX}avg_amount"),
                 F.stddev_samp(AMOUNT).alias(f"{CTX_PREFIX}sd_amount")]
    if TS in df.columns:
        aggs += [F.avg(F.hour(TS)).alias(f"{CTX_PREFIX}avg_hour"), F.count(TS).alias(f"{CTX_PREFIX}timed")]
    if ID in df.columns:
        aggs += [F.min(ID).alias(f"{CTX_PREFIX}min_id")]
    stats = df.groupBy(CARD).agg(*aggs)
    if TS in df.columns and ID in df.columns:
        ranges = {f"{CTX_PREFIX}cnt24_incl": (-24 * HOUR_US, 0)}
        for w in windows_excl_hours:
            ranges[f"{CTX_PREFIX}cnt_{w}h"] = (-int(w * HOUR_US), -1)
        prev_cols = [AMOUNT] if AMOUNT in df.columns else []
        if method == "auto":
            method = "context" if fits_time_buckets(df, [CARD], TS, bucket_hours, rows_per_part) else "volume"
        if method == "volume":
            df = range_counts_probe(df, [CARD], TS, ID, ranges, rows_per_part=rows_per_part)
            df = sequence_stage(df, [CARD], TS, ID, prev_cols=prev_cols, rows_per_part=rows_per_part)
        elif method == "probe":
            df = range_counts_probe(df, [CARD], TS, ID, ranges, bucket_hours=bucket_hours)
            df = sequence_stage(df, [CARD], TS, ID, prev_cols=prev_cols, ranges={}, bucket_hours=bucket_hours)
        else:
            df = sequence_stage(df, [CARD], TS, ID, prev_cols=prev_cols, ranges=ranges, bucket_hours=bucket_hours)
        df = df.withColumnRenamed("_prev", f"{CTX_PREFIX}prev").withColumnRenamed("_us", f"{CTX_PREFIX}us")
    return attach_stats(df, stats, [CARD])


def drop_context(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(CTX_PREFIX)])


def _with_context(df: DataFrame, **kw) -> tuple[DataFrame, bool]:
    if f"{CTX_PREFIX}cnt" in df.columns:
        return df, False
    return add_card_context(df, **kw), True


# ---------------------------------------------------------------- AGG5/WIN1/WIN2
def customer_behavior_features(df: DataFrame) -> DataFrame:
    if not _has(df, CARD, AMOUNT, TS, ID):
        return df
    df, own = _with_context(df)
    p = f"{CTX_PREFIX}"
    # rows without a time sort after all others of the card
    leads = F.col(f"{p}us").isNotNull() | ((F.col(f"{p}timed") == 0) & (F.col(ID) == F.col(f"{p}min_id")))
    df = df.withColumns({"customer_transaction_count": F.col(f"{p}cnt"),
                         "customer_avg_amount": F.col(f"{p}avg_amount"),
                         "amount_deviation_from_avg": safe_div(AMOUNT, f"{p}avg_amount"),
                         "amount_diff_last_transaction": F.col(AMOUNT) - F.col(f"{p}prev.{AMOUNT}"),
                         "is_first_transaction": flag(F.col(f"{p}prev").isNull() & leads)})
    return drop_context(df) if own else df


# ---------------------------------------------------------------- AGG3/WIN10
def merchant_features(df: DataFrame, merchant: str = "merchant_id", rows: DataFrame | None = None) -> DataFrame:
    if merchant not in df.columns:
        return df
    rows = df if rows is None else rows
    aggs = [F.count(ID).alias("merchant_transaction_count") if ID in df.columns
            else F.count(F.lit(1)).alias("merchant_transaction_count"), F.count(F.lit(1)).alias("_rows")]
    if AMOUNT in df.columns:
        aggs.append(F.avg(AMOUNT).alias("merchant_avg_amount"))
    if LABEL in df.columns:
        aggs.append(F.avg(LABEL).alias("merchant_fraud_rate"))
    st = rows.where(F.col(merchant).isNotNull()).groupBy(merchant).agg(*aggs)  # rows without a merchant have no rate
    if LABEL in df.columns:
        r = F.least(F.greatest(F.col("merchant_fraud_rate"), F.lit(0.0)), F.lit(1.0))
        st = st.withColumn("_rc", r)
        # fitted once from the per-merchant table: row-weighted quartiles, median, distinct rates
        st = written(st, "merchant-rates")
        e = weighted_quantiles(st, "_rc", "_rows", QUARTILES) or [None] * 5
        med, n_unique = e[2], st.agg(F.count_distinct("_rc")).first()[0]
        x = F.col("_rc")
        m = F.lit(med).cast("double")
        ladder = (F.when(x <= m / 2, "low_risk").when(x <= m, "medium_low_risk")
                  .when(x <= m * 1.5, "medium_high_risk").otherwise("high_risk"))
        if n_unique >= 4:
            strict = all(v is not None for v in e) and all(e[i] < e[i + 1] for i in range(4))
            cat = cut(x, e, RISK_LABELS_4, include_lowest=True) if strict else ladder
        elif n_unique <= 2:
            cat = F.when(x <= m, "low_risk").otherwise("high_risk")
        else:
            cat = F.when(x <= m * 0.5, "low_risk").when(x <= m * 1.5, "medium_risk").otherwise("high_risk")
        st = st.withColumn("merchant_risk_category", cat).drop("_rc")
    return attach_stats(df, st.drop("_rows"), [merchant])


# ---------------------------------------------------------------- AGG4/SCL12/SCL13/JN4
def payment_method_features(df: DataFrame, columns=PAYMENT_COLUMNS, home_country: str = HOME_COUNTRY,
                            rates: dict[str, DataFrame] | None = None) -> DataFrame:
    """Fraud rate per value of each payment column, all from one pass; ``rates``: from ``rate_stats`` (default: of ``df``)."""
    columns = list(columns)
    if not _has(df, *columns):
        return df
    if _has(df, "payment_method", "capture_method"):
        # concat is null when either part is null
        df = df.withColumn("payment_capture_combo", F.concat("payment_method", F.lit("_"), "capture_method"))
    if LABEL in df.columns:
        rates = rates or rate_stats(df, columns)
        for c in columns:
            r = rates[c].where(F.col(c).isNotNull()).select(c, F.try_divide(F.col("_s"), F.col("_n")).alias(f"{c}_fraud_rate"))
            df = attach_stats(df, r, [c])
    if "issuer_country" in df.columns:
        df = df.withColumn("is_international", flag(~F.col("issuer_country").eqNullSafe(F.lit(home_country))))
    return df


# ---------------------------------------------------------------- WIN3/WIN4/WIN5
def velocity_features(df: DataFrame) -> DataFrame:
    df = resolve_timestamp(df)
    if not _has(df, CARD, TS, ID):
        return df
    df, own = _with_context(df)
    p = CTX_PREFIX
    gap = F.coalesce((F.col(f"{p}us") - F.col(f"{p}prev._us")) / F.lit(60_000_000.0), F.lit(float(NO_PREVIOUS_MINUTES)))
    df = df.withColumns({"time_since_last_transaction": gap, "is_quick_transaction": flag(gap < QUICK_MINUTES),
                         "transaction_count_last_24h":
                             F.when(F.col(f"{p}rows") > 1, F.col(f"{p}cnt24_incl")).otherwise(F.lit(0)).cast("long")})
    return drop_context(df) if own else df


# ---------------------------------------------------------------- WIN8/AGG9/SCL14
def fraud_pattern_features(df: DataFrame) -> DataFrame:
    if not _has(df, CARD):
        return df
    df, own = _with_context(df)
    p = CTX_PREFIX
    if _has(df, AMOUNT, TS, ID):
        prev = F.col(f"{p}prev.{AMOUNT}")
        ratio = safe_div(AMOUNT, prev)
        df = df.withColumns({"amount_ratio_to_previous": ratio,
                             "high_amount_increase": flag((ratio > 5) | ((prev == 0) & (F.col(AMOUNT) > 0)))})
    if _has(df, "hour_of_day", TS):
        d = cyclic_distance("hour_of_day", f"{p}avg_hour")
        df = df.withColumn("unusual_hour_for_customer", flag(d > 6))
    return drop_context(df) if own else df


# ---------------------------------------------------------------- FE1
def create_all_features(df: DataFrame, bucket_hours: float = 168, materialize: bool = True,
                        method: str = "auto", rows_per_part: int = ROWS_PER_PART,
                        home_country: str = HOME_COUNTRY) -> DataFrame:
    """temporal -> amount -> location -> customer -> merchant -> payment -> velocity -> pattern.

    The input feeds about a dozen branches (location, merchant and card
    aggregates, the sequence stage and its context rows). With
    ``materialize`` the input rows (typically a star-schema join) are
    written once to the shared checkpoint folder and every branch reads
    them, instead of re-running the scan and joins per branch.
    """
    if materialize:
        df = write_and_read(df, "fe1-input")
    df = temporal_features(df)
    df = amount_features(df)
    rows = df  # the statistics of every stage come from these narrow rows, not from the joined ones
    places = ["merchant_city", "merchant_state"]
    payment = list(PAYMENT_COLUMNS)
    columns = [*(places if _has(df, *places) else []), *(payment if _has(df, *payment) else [])]
    rates = rate_stats(rows, columns) if columns and LABEL in df.columns else None
    df = add_card_context(df, bucket_hours=bucket_hours, method=method, rows_per_part=rows_per_part)
    df = location_features(df, rates=rates)
    df = customer_behavior_features(df)
    df = merchant_features(df, rows=rows)
    df = payment_method_features(df, home_country=home_country, rates=rates)
    df = velocity_features(df)
    df = fraud_pattern_features(df)
    return drop_context(df)
