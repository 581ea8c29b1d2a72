"""Exploration, monitoring, cleaning, filter/join/set and rule-scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklib.functions.exprs import flag, weekday
from risklib.operators import clean as CL
from risklib.operators import eda as ED
from risklib.operators import features as FT
from risklib.operators import scores as SCO
from risklib.plans.common import rounded
from risklib.plans.sqlviews import EV, LINES, ORD, SC, TX_EVENTS, TX_ORDERS, with_
from risklib.sources.tables import scored, tx_events, tx_line_locations, tx_lines, tx_orders

Q, SQL = {}, {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


# ---------------------------------------------------------------- AGG12
def _desc_sql(col: str) -> str:
    x = f"CAST({col} AS DOUBLE)"
    return f"""SELECT '{col}' AS column, stat, ROUND(value, 6) AS value FROM (
  SELECT count({x}) AS c, avg({x}) AS m, stddev_samp({x}) AS s, min({x}) AS mn,
         quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS q2, quantile_cont({x}, 0.75) AS q3, max({x}) AS mx
  FROM tx_events) UNPIVOT (value FOR stat IN (c AS 'count', m AS 'mean', s AS 'std', mn AS 'min', q1 AS '25%',
                                              q2 AS '50%', q3 AS '75%', mx AS 'max'))"""


@reg("agg12_describe", EV + " UNION ALL ".join(_desc_sql(c) for c in ["amount", "mcc", "fraud_indicator"]))
def agg12_describe(spark, sf):
    return rounded(ED.describe(tx_events(spark, sf), ["amount", "mcc", "fraud_indicator"]))


# ---------------------------------------------------------------- AGG13
@reg("agg13_class_distribution", EV + """SELECT fraud_indicator, count(*) AS count,
  ROUND(count(*) / (SELECT count(*) FROM tx_events), 6) AS share FROM tx_events GROUP BY 1""")
def agg13_class_distribution(spark, sf):
    return rounded(ED.class_distribution(tx_events(spark, sf)))


# ---------------------------------------------------------------- AGG14/AGG15/AGG19
_XT = """CAST(sum(CASE WHEN fraud_indicator = 0 THEN 1 ELSE 0 END) AS BIGINT) AS legit,
  CAST(sum(CASE WHEN fraud_indicator = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fraud"""


@reg("agg14_hour_by_label", EV + f"SELECT CAST(hour(transaction_ts) AS INTEGER) AS hour, {_XT} FROM tx_events GROUP BY 1")
def agg14_hour_by_label(spark, sf):
    return ED.hour_by_label(tx_events(spark, sf))


@reg("agg15_dayname_by_label", EV + f"""SELECT CAST(isodow(transaction_ts) - 1 AS INTEGER) AS weekday,
  dayname(transaction_ts) AS day_name, {_XT} FROM tx_events GROUP BY 1, 2""")
def agg15_dayname_by_label(spark, sf):
    return ED.dayname_by_label(tx_events(spark, sf))


@reg("agg19_category_crosstab", EV + f"SELECT merchant_category, {_XT} FROM tx_events GROUP BY 1")
def agg19_category_crosstab(spark, sf):
    return ED.label_crosstab(tx_events(spark, sf), "merchant_category")


# ---------------------------------------------------------------- AGG16/AGG26/AGG27
def _trend_sql(per: str, step: str, gen: str | None = None) -> str:
    gen = gen or f"SELECT unnest(generate_series(lo, hi, INTERVAL {step}))::DATE AS period FROM b"
    return ORD + f""", g AS (SELECT {per} AS period, count(*) AS total, sum(fraud_indicator) AS fraud
   FROM tx_orders WHERE transaction_ts IS NOT NULL GROUP BY 1),
b AS (SELECT min(period) AS lo, max(period) AS hi FROM g),
p AS ({gen}),
t AS (SELECT p.period, CAST(coalesce(g.total, 0) AS BIGINT) AS total, CAST(coalesce(g.fraud, 0) AS BIGINT) AS fraud
   FROM p LEFT JOIN g ON p.period = g.period)
"""


_DAILY = _trend_sql("CAST(transaction_ts AS DATE)", "1 DAY")
_WEEKLY = _trend_sql("CAST(date_trunc('week', transaction_ts) AS DATE) + 6", "7 DAY")
_MONTHLY = _trend_sql("last_day(CAST(transaction_ts AS DATE))", "1 MONTH",
                      "SELECT last_day(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)))::DATE AS period FROM b")
_TREND_SEL = """SELECT strftime(period, '%Y-%m-%d') AS period, total, fraud,
  ROUND(coalesce(CASE WHEN total > 0 THEN fraud / total END, 0.0), 6) AS fraud_rate FROM t"""


def _trend_q(freq):
    def fn(spark, sf):
        t = ED.trend(tx_orders(spark, sf, with_location=False), freq)
        return rounded(t.withColumn("period", _day("period")))
    return fn


Q["agg16_trend_daily"], SQL["agg16_trend_daily"] = _trend_q("daily"), _DAILY + _TREND_SEL
Q["agg16_trend_weekly"], SQL["agg16_trend_weekly"] = _trend_q("weekly"), _WEEKLY + _TREND_SEL
Q["agg16_trend_monthly"], SQL["agg16_trend_monthly"] = _trend_q("monthly"), _MONTHLY + _TREND_SEL


@reg("agg26_daily_fraud_pct", _DAILY + """SELECT strftime(period, '%Y-%m-%d') AS period,
  ROUND(coalesce(CASE WHEN total > 0 THEN fraud / total END, 0.0) * 100, 6) AS fraud_pct FROM t""")
def agg26_daily_fraud_pct(spark, sf):
    t = ED.trend(tx_orders(spark, sf, with_location=False), "daily")
    return rounded(t.select(_day("period").alias("period"), (F.col("fraud_rate") * 100).alias("fraud_pct")))


@reg("agg27_kpi_deltas", _DAILY + """, k AS (SELECT period, total, fraud,
   coalesce(CASE WHEN total > 0 THEN fraud / total END, 0.0) * 100 AS fraud_pct FROM t),
l AS (SELECT *, lag(total) OVER (ORDER BY period) AS pt, lag(fraud) OVER (ORDER BY period) AS pf,
   lag(fraud_pct) OVER (ORDER BY period) AS pp FROM k)
SELECT strftime(period, '%Y-%m-%d') AS period, total, fraud, ROUND(fraud_pct, 6) AS fraud_pct,
  CAST(total - pt AS DOUBLE) AS total_delta, ROUND(CASE WHEN pt <> 0 THEN (total - pt) / pt END, 6) AS total_change,
  CAST(fraud - pf AS DOUBLE) AS fraud_delta, ROUND(CASE WHEN pf <> 0 THEN (fraud - pf) / pf END, 6) AS fraud_change,
  ROUND(fraud_pct - pp, 6) AS fraud_pct_delta, ROUND(CASE WHEN pp <> 0 THEN (fraud_pct - pp) / pp END, 6) AS fraud_pct_change
FROM l""")
def agg27_kpi_deltas(spark, sf):
    k = ED.kpi_deltas(tx_orders(spark, sf, with_location=False)).drop("fraud_rate")
    return rounded(k.withColumn("period", _day("period")))


# ---------------------------------------------------------------- AGG17/FLT2/AGG28/AGG31
@reg("agg17_group_fraud_min5", LINES + """SELECT merchant_city, count(*) AS total, CAST(sum(fraud_indicator) AS BIGINT) AS fraud,
  ROUND(sum(fraud_indicator) / count(*), 6) AS fraud_rate FROM tx_lines GROUP BY 1 HAVING count(*) >= 5""")
def agg17_group_fraud_min5(spark, sf):
    return rounded(ED.group_fraud(tx_lines(spark, sf), "merchant_city", 5))


@reg("flt2_min_count_filter", LINES + """SELECT merchant_id, count(*) AS total, CAST(sum(fraud_indicator) AS BIGINT) AS fraud,
  ROUND(sum(fraud_indicator) / count(*), 6) AS fraud_rate FROM tx_lines GROUP BY 1 HAVING count(*) >= 600""")
def flt2_min_count_filter(spark, sf):
    return rounded(ED.group_fraud(tx_lines(spark, sf, with_location=False), "merchant_id", 600))


@reg("agg28_category_shares", EV + """SELECT merchant_category, count(*) AS count,
  ROUND(count(*) / (SELECT count(*) FROM tx_events), 6) AS share FROM tx_events GROUP BY 1""")
def agg28_category_shares(spark, sf):
    return rounded(ED.shares(tx_events(spark, sf), "merchant_category"))


@reg("agg28_hour_shares", EV + """SELECT CAST(hour(transaction_ts) AS INTEGER) AS hour, count(*) AS count,
  ROUND(count(*) / (SELECT count(*) FROM tx_events), 6) AS share FROM tx_events GROUP BY 1""")
def agg28_hour_shares(spark, sf):
    return rounded(ED.shares(tx_events(spark, sf).withColumn("hour", F.hour("transaction_ts")), "hour"))


@reg("agg31_location_hotspots", ORD + """SELECT merchant_city, merchant_state, count(*) AS total,
  CAST(sum(fraud_indicator) AS BIGINT) AS fraud, CAST(dense_rank() OVER (ORDER BY sum(fraud_indicator) DESC) AS INTEGER) AS rank
  FROM tx_orders GROUP BY 1, 2""")
def agg31_location_hotspots(spark, sf):
    return ED.hotspots(tx_orders(spark, sf), "merchant_city", "merchant_state")


# ---------------------------------------------------------------- AGG18
@reg("agg18_state_city_rate", ORD + """SELECT merchant_state, merchant_city,
  ROUND(sum(fraud_indicator) / count(*), 6) AS fraud_rate FROM tx_orders GROUP BY 1, 2 HAVING count(*) >= 3""")
def agg18_state_city_rate(spark, sf):
    return rounded(ED.pair_rate_long(tx_orders(spark, sf), "merchant_state", "merchant_city", 3))


# ---------------------------------------------------------------- AGG20/AGG21
@reg("agg20_amount_histogram", EV + """, mm AS (SELECT min(amount) AS lo, max(amount) AS hi FROM tx_events),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((amount - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bin,
   fraud_indicator, lo, hi FROM tx_events, mm WHERE amount IS NOT NULL)
SELECT bin, fraud_indicator, count(*) AS count, ROUND(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 20, 6) AS bin_lo,
  ROUND(any_value(lo) + (bin + 1) * (any_value(hi) - any_value(lo)) / 20, 6) AS bin_hi FROM b GROUP BY 1, 2""")
def agg20_amount_histogram(spark, sf):
    return rounded(ED.histogram(tx_events(spark, sf), "amount", 20))


@reg("agg21_box_stats", EV + """, q AS (SELECT fraud_indicator, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS median,
   quantile_cont(amount, 0.75) AS q3 FROM tx_events GROUP BY 1)
SELECT t.fraud_indicator, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
  ROUND(min(CASE WHEN amount >= q1 - 1.5 * (q3 - q1) THEN amount END), 6) AS whisker_lo,
  ROUND(max(CASE WHEN amount <= q3 + 1.5 * (q3 - q1) THEN amount END), 6) AS whisker_hi,
  count(CASE WHEN amount < q1 - 1.5 * (q3 - q1) OR amount > q3 + 1.5 * (q3 - q1) THEN 1 END) AS outliers
FROM tx_events t JOIN q ON t.fraud_indicator = q.fraud_indicator GROUP BY 1, 2, 3, 4""")
def agg21_box_stats(spark, sf):
    return rounded(ED.box_stats(tx_events(spark, sf), "amount"))


# ---------------------------------------------------------------- AGG22/AGG23
_CORR_COLS = ["amount", "mcc", "fraud_indicator", "card_number"]


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for j, b in enumerate(_CORR_COLS):
            if i < j:
                e = f"(SELECT ROUND(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) + 0.0 FROM tx_events)"
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {e} AS r")
                parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {e} AS r")
    return EV + " UNION ALL ".join(parts)


@reg("agg22_correlation_matrix", _corr_sql())
def agg22_correlation_matrix(spark, sf):
    return rounded(ED.correlation_long(tx_events(spark, sf), _CORR_COLS))


@reg("agg22_correlation_blocks", _corr_sql())
def agg22_correlation_blocks(spark, sf):
    """The same matrix from Gram matrices of column blocks, two columns a block."""
    return rounded(ED.correlation_blocks(tx_events(spark, sf), _CORR_COLS, block=2))


@reg("agg23_target_correlation_top3", ORD + """, c AS (
  SELECT 'amount' AS feature, corr(amount, CAST(fraud_indicator AS DOUBLE)) AS r FROM tx_orders
  UNION ALL SELECT 'card_number', corr(CAST(card_number AS DOUBLE), CAST(fraud_indicator AS DOUBLE)) FROM tx_orders
  UNION ALL SELECT 'transaction_id', corr(CAST(transaction_id AS DOUBLE), CAST(fraud_indicator AS DOUBLE)) FROM tx_orders)
SELECT feature, ROUND(r, 6) AS r, CAST(row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM c
QUALIFY rank <= 3""")
def agg23_target_correlation_top3(spark, sf):
    return rounded(ED.target_correlation(tx_orders(spark, sf), top=3))


# ---------------------------------------------------------------- AGG24
@reg("agg24_customer_history", EV + """, h AS (SELECT transaction_id, amount, epoch_us(transaction_ts) AS us,
   count(*) OVER w AS prior_count, sum(CAST(round(amount * 100) AS BIGINT)) OVER w AS s, count(amount) OVER w AS n,
   min(epoch_us(transaction_ts)) OVER (PARTITION BY card_number) AS first_us
   FROM tx_events WINDOW w AS (PARTITION BY card_number ORDER BY epoch_us(transaction_ts), transaction_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT transaction_id, prior_count, CASE WHEN n > 0 THEN CAST(s AS DOUBLE) / 100.0 / n END AS history_mean_amount,
  CASE WHEN n > 0 AND s <> 0 THEN amount / (CAST(s AS DOUBLE) / 100.0 / n) END AS amount_to_history_ratio,
  CASE WHEN prior_count > 0 THEN (us - first_us) / 86400000000.0 / prior_count END AS days_per_transaction
FROM h""")
def agg24_customer_history(spark, sf):
    h = ED.customer_history(tx_events(spark, sf))
    return h.select("transaction_id", "prior_count", "history_mean_amount", "amount_to_history_ratio",
                    "days_per_transaction")


# ---------------------------------------------------------------- AGG25
@reg("agg25_kpis", EV + """SELECT count(*) AS total_transactions, CAST(sum(fraud_indicator) AS BIGINT) AS fraud_count,
  ROUND(avg(fraud_indicator) * 100, 6) AS fraud_pct, ROUND(avg(amount), 6) AS avg_amount FROM tx_events""")
def agg25_kpis(spark, sf):
    return rounded(ED.kpis(tx_events(spark, sf)))


# ---------------------------------------------------------------- TOP1/TOP2
@reg("top1_top_merchants_by_volume", LINES + """SELECT merchant_id, count(*) AS total FROM tx_lines GROUP BY 1
  ORDER BY total DESC, merchant_id LIMIT 10""")
def top1_top_merchants_by_volume(spark, sf):
    return ED.top_by_volume(tx_lines(spark, sf, with_location=False), "merchant_id")


@reg("top2_top_merchants_by_fraud_rate", LINES + """SELECT merchant_id, count(*) AS total, CAST(sum(fraud_indicator) AS BIGINT) AS fraud,
  ROUND(sum(fraud_indicator) / count(*), 6) AS fraud_rate FROM tx_lines GROUP BY 1 HAVING count(*) >= 5
  ORDER BY sum(fraud_indicator) / count(*) DESC, total DESC, merchant_id LIMIT 10""")
def top2_top_merchants_by_fraud_rate(spark, sf):
    return rounded(ED.top_by_fraud_rate(tx_lines(spark, sf, with_location=False), "merchant_id"))


# ---------------------------------------------------------------- SET1 / SMP1
@reg("set1_union_history", with_(TX_EVENTS, TX_ORDERS) + """SELECT transaction_id, card_number, amount, merchant_category,
  NULL AS merchant_city FROM tx_events
UNION ALL SELECT transaction_id, card_number, amount, NULL, merchant_city FROM tx_orders""")
def set1_union_history(spark, sf):
    a = tx_events(spark, sf).select("transaction_id", "card_number", "amount", "merchant_category")
    b = tx_orders(spark, sf).select("transaction_id", "card_number", "amount", "merchant_city")
    return a.unionByName(b, allowMissingColumns=True)


@reg("smp1_hash_sample", EV + """SELECT transaction_id, amount FROM tx_events
  WHERE CAST(('0x' || substr(md5(CAST(transaction_id AS VARCHAR) || '42'), 1, 8)) AS BIGINT) < 429496729""")
def smp1_hash_sample(spark, sf):
    return ED.hash_sample(tx_events(spark, sf), "transaction_id", 0.1).select("transaction_id", "amount")


# ---------------------------------------------------------------- FLT1/FLT3
@reg("flt1_false_positive_rows", SC + """SELECT transaction_id, fraud_probability FROM scored
  WHERE true_label = 0 AND fraud_probability >= 0.5 AND merchant_category = 'purchase'""")
def flt1_false_positive_rows(spark, sf):
    s = scored(spark, sf)
    return s.where((F.col("true_label") == 0) & (F.col("fraud_probability") >= 0.5)
                   & (F.col("merchant_category") == "purchase")).select("transaction_id", "fraud_probability")


@reg("flt3_look_back_7d", EV + """SELECT transaction_id, amount FROM tx_events
  WHERE transaction_ts > (SELECT max(transaction_ts) FROM tx_events) - INTERVAL 7 DAY
    AND transaction_ts <= (SELECT max(transaction_ts) FROM tx_events)""")
def flt3_look_back_7d(spark, sf):
    return ED.look_back(tx_events(spark, sf), "7 days").select("transaction_id", "amount")


# ---------------------------------------------------------------- JN7/JN8
@reg("jn7_star_schema", ORD + """SELECT transaction_id, card_number, amount, strftime(transaction_ts, '%Y-%m-%d %H:%M:%S') AS ts,
  merchant_city, merchant_state, payment_method, issuer_bank, fraud_indicator FROM tx_orders""")
def jn7_star_schema(spark, sf):
    t = tx_orders(spark, sf)
    return t.withColumn("ts", F.date_format("transaction_ts", "yyyy-MM-dd HH:mm:ss")).drop("transaction_ts")


@reg("jn8_prediction_alignment", SC + """SELECT s.transaction_id, s.fraud_probability, t.fraud_indicator
  FROM scored s JOIN tx_events t ON s.transaction_id = t.transaction_id""")
def jn8_prediction_alignment(spark, sf):
    preds = scored(spark, sf).select("transaction_id", "fraud_probability")
    labels = tx_events(spark, sf).select("transaction_id", "fraud_indicator")
    return preds.join(labels, "transaction_id")


# ---------------------------------------------------------------- CLN
@reg("cln1_drop_columns", ORD + "SELECT transaction_id, card_number, amount, merchant_city, merchant_state, fraud_indicator FROM tx_orders")
def cln1_drop_columns(spark, sf):
    return CL.drop_columns(tx_orders(spark, sf), ["payment_method", "issuer_bank", "transaction_ts", "not_there"])


_SEQ_DIFF = EV + """, d AS (SELECT transaction_id, merchant_category,
   amount - lag(amount) OVER (PARTITION BY card_number ORDER BY epoch_us(transaction_ts), transaction_id) AS amount_diff,
   CASE WHEN row_number() OVER (PARTITION BY card_number ORDER BY epoch_us(transaction_ts), transaction_id) = 1
        THEN NULL ELSE merchant_category END AS repeat_category FROM tx_events)
"""


@reg("cln2_impute_median_mode", _SEQ_DIFF + """SELECT transaction_id, merchant_category,
  ROUND(coalesce(amount_diff, (SELECT quantile_cont(amount_diff, 0.5) FROM d)), 6) AS amount_diff,
  coalesce(repeat_category, (SELECT repeat_category FROM d WHERE repeat_category IS NOT NULL GROUP BY 1
                             ORDER BY count(*) DESC, repeat_category LIMIT 1)) AS repeat_category FROM d""")
def cln2_impute_median_mode(spark, sf):
    df = FT.customer_behavior_features(tx_events(spark, sf)).select(
        "transaction_id", "merchant_category", F.col("amount_diff_last_transaction").alias("amount_diff"),
        F.when(F.col("is_first_transaction") == 0, F.col("merchant_category")).alias("repeat_category"))
    return rounded(CL.impute(df, exclude=["transaction_id"]))


@reg("cln4_combine_datetime", EV + """SELECT transaction_id,
  strftime(CAST(strftime(transaction_ts, '%Y-%m-%d') || ' ' || strftime(transaction_ts, '%H:%M:%S') AS TIMESTAMP),
           '%Y-%m-%d %H:%M:%S') AS ts FROM tx_events""")
def cln4_combine_datetime(spark, sf):
    t = tx_events(spark, sf).select("transaction_id", F.date_format("transaction_ts", "yyyy-MM-dd").alias("transaction_date"),
                                    F.date_format("transaction_ts", "HH:mm:ss").alias("transaction_time"))
    r = FT.resolve_timestamp(t)
    return r.select("transaction_id", F.date_format("transaction_ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@reg("cln8_null_summary", ORD + """SELECT "column", dtype, non_null, (SELECT count(*) FROM tx_orders) - non_null AS nulls FROM (
  SELECT 'transaction_id' AS "column", 'bigint' AS dtype, count(transaction_id) AS non_null FROM tx_orders
  UNION ALL SELECT 'card_number', 'bigint', count(card_number) FROM tx_orders
  UNION ALL SELECT 'amount', 'double', count(amount) FROM tx_orders
  UNION ALL SELECT 'transaction_ts', 'timestamp', count(transaction_ts) FROM tx_orders
  UNION ALL SELECT 'merchant_city', 'string', count(merchant_city) FROM tx_orders
  UNION ALL SELECT 'merchant_state', 'string', count(merchant_state) FROM tx_orders
  UNION ALL SELECT 'payment_method', 'string', count(payment_method) FROM tx_orders
  UNION ALL SELECT 'issuer_bank', 'string', count(issuer_bank) FROM tx_orders
  UNION ALL SELECT 'fraud_indicator', 'int', count(fraud_indicator) FROM tx_orders)""")
def cln8_null_summary(spark, sf):
    return CL.null_summary(tx_orders(spark, sf))


# ---------------------------------------------------------------- SCL3/SCL7/SCL9/AGG11
@reg("scl7_pipeline_extractors", EV + """, x AS (SELECT transaction_id, amount, CAST(hour(transaction_ts) AS INTEGER) AS hour,
   CAST(day(transaction_ts) AS INTEGER) AS day, CAST(month(transaction_ts) AS INTEGER) AS month,
   CAST(isodow(transaction_ts) - 1 AS INTEGER) AS day_of_week FROM tx_events),
y AS (SELECT *, CAST(day_of_week >= 5 AS INTEGER) AS is_weekend,
   CASE WHEN hour < 6 THEN 'early_morning' WHEN hour < 12 THEN 'morning' WHEN hour < 18 THEN 'afternoon' ELSE 'night' END AS period_of_day_b,
   (amount - (SELECT avg(amount) FROM tx_events)) / (SELECT stddev_samp(amount) FROM tx_events) AS z FROM x)
SELECT transaction_id, hour, day, month, day_of_week, is_weekend, period_of_day_b,
  CASE WHEN amount > 0 AND amount <= 50 THEN 'very_low' WHEN amount > 50 AND amount <= 100 THEN 'low'
       WHEN amount > 100 AND amount <= 500 THEN 'medium' WHEN amount > 500 AND amount <= 1000 THEN 'high'
       WHEN amount > 1000 THEN 'very_high' END AS amount_band5,
  ROUND(z, 6) AS amount_zscore_global, CAST(coalesce(abs(z) > 3, false) AS INTEGER) AS is_amount_outlier,
  CAST(is_weekend = 1 AND period_of_day_b = 'early_morning' AS INTEGER) AS high_risk_time FROM y""")
def scl7_pipeline_extractors(spark, sf):
    d = CL.custom_extractor(CL.datetime_extractor(tx_events(spark, sf)))
    return rounded(d.select("transaction_id", "hour", "day", "month", "day_of_week", "is_weekend", "period_of_day_b",
                            "amount_band5", "amount_zscore_global", "is_amount_outlier", "high_risk_time"))


# ---------------------------------------------------------------- SCL15/SCL16/SCL17
@reg("scl15_score_bands", SC + """SELECT transaction_id,
  CASE WHEN fraud_probability >= 0.8 THEN 'high' WHEN fraud_probability >= 0.7 THEN 'elevated' ELSE 'normal' END AS score_band,
  CASE WHEN fraud_probability * 100 >= 0 AND fraud_probability * 100 <= 25 THEN 'baixo'
       WHEN fraud_probability * 100 > 25 AND fraud_probability * 100 <= 50 THEN 'medio'
       WHEN fraud_probability * 100 > 50 AND fraud_probability * 100 <= 75 THEN 'alto'
       WHEN fraud_probability * 100 > 75 AND fraud_probability * 100 <= 100 THEN 'muito_alto' END AS score_category
FROM scored""")
def scl15_score_bands(spark, sf):
    from risklib.functions.exprs import cut
    from risklib.operators.advanced import RISK_CATEGORY_LABELS
    s = scored(spark, sf)
    p = F.col("fraud_probability")
    return s.select("transaction_id", F.when(p >= 0.8, "high").when(p >= 0.7, "elevated").otherwise("normal").alias("score_band"),
                    cut(p * 100, [0, 25, 50, 75, 100], RISK_CATEGORY_LABELS, include_lowest=True).alias("score_category"))


@reg("scl17_padded_ids", EV + """SELECT printf('TX%010d', transaction_id) AS tx_code, printf('CARD%08d', card_number) AS card_code,
  'ALT-' || lpad(CAST(transaction_id AS VARCHAR), 6, '0') AS alert_code, strftime(transaction_ts, '%Y-%m-%d') AS tx_date
FROM tx_events""")
def scl17_padded_ids(spark, sf):
    t = tx_events(spark, sf)
    return t.select(F.format_string("TX%010d", "transaction_id").alias("tx_code"),
                    F.format_string("CARD%08d", "card_number").alias("card_code"),
                    F.concat(F.lit("ALT-"), F.lpad(F.col("transaction_id").cast("string"), 6, "0")).alias("alert_code"),
                    F.date_format("transaction_ts", "yyyy-MM-dd").alias("tx_date"))


# ---------------------------------------------------------------- SCO5/SCO7/SCO8/SCO10/WIN9
def _rule(spark, sf):
    t = tx_events(spark, sf).withColumn("merchant_id", F.col("mcc"))
    t = SCO.new_merchant_flag(t, "merchant_id")
    return SCO.rule_score(t, 0.5, new_merchant=F.col("is_new_merchant") == 1)


_RULE_SQL = EV + """, r AS (SELECT transaction_id, amount, transaction_ts,
   CAST(amount > 1000 AS INTEGER) AS rf_high_amount,
   CAST(hour(transaction_ts) < 5 OR hour(transaction_ts) > 22 AS INTEGER) AS rf_unusual_time,
   0 AS rf_international,
   CAST(row_number() OVER (PARTITION BY card_number, mcc ORDER BY transaction_ts, transaction_id) = 1 AS INTEGER) AS rf_new_merchant,
   0 AS rf_online_payment FROM tx_events),
p AS (SELECT *, least(0.05 + 0.15 * (rf_high_amount + rf_unusual_time + rf_international + rf_new_merchant + rf_online_payment), 0.99)
   AS fraud_probability FROM r)
"""


@reg("sco5_rule_score", _RULE_SQL + """SELECT transaction_id, rf_high_amount, rf_unusual_time, rf_international, rf_new_merchant,
  rf_online_payment, ROUND(fraud_probability, 6) AS fraud_probability, CAST(fraud_probability >= 0.5 AS INTEGER) AS is_fraud,
  CASE WHEN fraud_probability >= 0.5 THEN 'Block transaction and investigate' ELSE 'Approve transaction' END AS recommendation FROM p""")
def sco5_rule_score(spark, sf):
    return rounded(_rule(spark, sf).select("transaction_id", "rf_high_amount", "rf_unusual_time", "rf_international",
                                           "rf_new_merchant", "rf_online_payment", "fraud_probability", "is_fraud",
                                           "recommendation"))


@reg("win9_new_merchant_flag", EV + """SELECT transaction_id, CAST(row_number() OVER (PARTITION BY card_number, mcc
  ORDER BY transaction_ts, transaction_id) = 1 AS INTEGER) AS is_new_merchant FROM tx_events""")
def win9_new_merchant_flag(spark, sf):
    t = tx_events(spark, sf).withColumn("merchant_id", F.col("mcc"))
    return SCO.new_merchant_flag(t, "merchant_id").select("transaction_id", "is_new_merchant")


@reg("sco7_threshold_decision", SC + """SELECT transaction_id, CAST(fraud_probability >= 0.6 AS INTEGER) AS is_fraud,
  CAST(fraud_probability > 0.6 AS INTEGER) AS is_fraud_strict,
  CASE WHEN fraud_probability >= 0.6 THEN 'Block transaction and investigate' ELSE 'Approve transaction' END AS recommendation
FROM scored""")
def sco7_threshold_decision(spark, sf):
    s = scored(spark, sf)
    a = SCO.decide(s, 0.6)
    b = a.withColumn("is_fraud_strict", flag(F.col("fraud_probability") > 0.6))
    return b.select("transaction_id", "is_fraud", "is_fraud_strict", "recommendation")


@reg("sco8_batch_summary", _RULE_SQL + """SELECT count(*) AS total_transactions,
  CAST(sum(CASE WHEN fraud_probability >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
  ROUND(sum(CASE WHEN fraud_probability >= 0.5 THEN 1 ELSE 0 END) / count(*), 6) AS flagged_share,
  ROUND(avg(fraud_probability), 6) AS mean_probability FROM p""")
def sco8_batch_summary(spark, sf):
    return rounded(SCO.batch_summary(_rule(spark, sf)))


@reg("sco8_suspicious_rows", _RULE_SQL + """SELECT transaction_id, ROUND(fraud_probability, 6) AS fraud_probability, amount
  FROM p WHERE fraud_probability >= 0.35""")
def sco8_suspicious_rows(spark, sf):
    r = _rule(spark, sf)
    return rounded(r.where(F.col("fraud_probability") >= 0.35).orderBy(F.desc("fraud_probability"), "transaction_id")
                   .select("transaction_id", "fraud_probability", "amount"))


@reg("sco10_risk_factor_table", _RULE_SQL + """, d(factor, description) AS (VALUES
  ('high_amount', 'Transaction amount is unusually high'), ('unusual_time', 'Transaction occurred during unusual hours'),
  ('international', 'Transaction is international'), ('new_merchant', 'First transaction with this merchant'),
  ('online_payment', 'Online payment (higher risk channel)')),
u AS (SELECT transaction_id, factor, CAST(v AS DOUBLE) AS risk_score FROM p
  UNPIVOT (v FOR factor IN (rf_high_amount AS 'high_amount', rf_unusual_time AS 'unusual_time', rf_international AS 'international',
                            rf_new_merchant AS 'new_merchant', rf_online_payment AS 'online_payment')))
SELECT u.transaction_id, u.factor, d.description, CASE WHEN risk_score = 1.0 THEN 'High' ELSE 'Low' END AS risk_level, risk_score
FROM u JOIN d ON u.factor = d.factor""")
def sco10_risk_factor_table(spark, sf):
    return SCO.risk_factor_table(_rule(spark, sf))


# ---------------------------------------------------------------- SCO6
def _rc_contrib():
    return {
        "Transaction Amount": F.lit(0.32),
        "Merchant Category": F.lit(0.12),
        "Previous Transactions": F.when(F.col("customer_transaction_count") > 10, -0.18).otherwise(0.22),
        "Unusual Hour": F.when((F.hour("transaction_ts") < 5) | (F.hour("transaction_ts") > 22), 0.15).otherwise(-0.05),
    }


@reg("sco6_reason_codes", EV + """, c AS (SELECT transaction_id, card_number, transaction_ts,
   count(transaction_id) OVER (PARTITION BY card_number) AS n FROM tx_events),
w AS (SELECT transaction_id, 'Transaction Amount' AS name, 0.32 AS w FROM c
  UNION ALL SELECT transaction_id, 'Merchant Category', 0.12 FROM c
  UNION ALL SELECT transaction_id, 'Previous Transactions', CASE WHEN n > 10 THEN -0.18 ELSE 0.22 END FROM c
  UNION ALL SELECT transaction_id, 'Unusual Hour', CASE WHEN hour(transaction_ts) < 5 OR hour(transaction_ts) > 22 THEN 0.15 ELSE -0.05 END FROM c)
SELECT transaction_id,
  coalesce(array_to_string(list_slice(list(name ORDER BY abs(w) DESC, name) FILTER (WHERE w > 0), 1, 3), '|'), '') AS top_positive,
  coalesce(array_to_string(list_slice(list(name ORDER BY abs(w) DESC, name) FILTER (WHERE w < 0), 1, 3), '|'), '') AS top_negative
FROM w GROUP BY transaction_id""")
def sco6_reason_codes(spark, sf):
    t = FT.customer_behavior_features(tx_events(spark, sf))
    return SCO.reason_codes(t, _rc_contrib()).select("transaction_id", "top_positive", "top_negative")


# ---------------------------------------------------------------- SCO9
@reg("sco9_risk_appetite", SC + """, h AS (SELECT CAST(least(greatest(floor(round(fraud_probability * 100, 6)), 0), 100) AS INTEGER) AS k,
   sum(true_label) AS pos, sum(1 - true_label) AS neg FROM scored GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS k FROM range(0, 101)),
f AS (SELECT g.k, coalesce(h.pos, 0) AS pos, coalesce(h.neg, 0) AS neg FROM g LEFT JOIN h ON g.k = h.k),
cc AS (SELECT k, sum(pos) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS tp,
   sum(neg) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS fp, sum(pos) OVER () AS P FROM f)
SELECT ROUND(k / 100, 6) AS threshold,
  CASE WHEN k / 100 >= 0.3 AND k / 100 <= 0.4 THEN 'Conservative' ELSE 'Permissive' END AS appetite,
  ROUND(coalesce(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 0.0), 6) AS precision,
  ROUND(coalesce(CASE WHEN P > 0 THEN tp / P END, 0.0), 6) AS recall
FROM cc WHERE (k >= 30 AND k <= 40) OR (k >= 60 AND k <= 80)""")
def sco9_risk_appetite(spark, sf):
    from risklib.operators import evaluate as EV_
    sw = EV_.threshold_sweep(scored(spark, sf))
    app = None
    for name, lo, hi in SCO.RISK_APPETITE:
        if lo is None:
            continue
        cond = (F.col("threshold") >= lo) & (F.col("threshold") <= hi)
        app = F.when(cond, F.lit(name)) if app is None else app.when(cond, F.lit(name))
    out = sw.withColumn("appetite", app).where(F.col("appetite").isNotNull())
    return rounded(out.select("threshold", "appetite", "precision", "recall"))


# ---------------------------------------------------------------- AGG29/AGG30
@reg("agg29_alert_summary", SC + """, a AS (SELECT CASE WHEN fraud_probability >= 0.9 THEN 'Critical' WHEN fraud_probability >= 0.8 THEN 'High'
      WHEN fraud_probability >= 0.7 THEN 'Medium' ELSE 'Low' END AS priority,
   CASE WHEN true_label = 1 THEN 'True Positive' ELSE 'False Positive' END AS disposition FROM scored WHERE fraud_probability >= 0.5),
c AS (SELECT priority, disposition, count(*) AS count FROM a GROUP BY 1, 2)
SELECT priority, disposition, count, ROUND(count / sum(count) OVER (PARTITION BY priority), 6) AS share FROM c""")
def agg29_alert_summary(spark, sf):
    from risklib.streaming.alerts import alerts_from_scores, alert_summary
    return rounded(alert_summary(alerts_from_scores(scored(spark, sf), 0.5)))


@reg("agg30_pattern_detection", _RULE_SQL + """, s AS (SELECT sum(f.fraud_indicator) AS P, sum(1 - f.fraud_indicator) AS N,
   sum(rf_high_amount) AS n1, sum(rf_high_amount * f.fraud_indicator) AS t1, sum(rf_high_amount * (1 - f.fraud_indicator)) AS f1,
   sum(rf_unusual_time) AS n2, sum(rf_unusual_time * f.fraud_indicator) AS t2, sum(rf_unusual_time * (1 - f.fraud_indicator)) AS f2,
   sum(rf_new_merchant) AS n3, sum(rf_new_merchant * f.fraud_indicator) AS t3, sum(rf_new_merchant * (1 - f.fraud_indicator)) AS f3
   FROM p JOIN tx_events f ON p.transaction_id = f.transaction_id)
SELECT 'rf_high_amount' AS pattern, CAST(n1 AS BIGINT) AS flagged, ROUND(coalesce(t1 / P, 0.0), 6) AS detection_rate, ROUND(coalesce(f1 / N, 0.0), 6) AS false_positive_rate FROM s
UNION ALL SELECT 'rf_unusual_time', CAST(n2 AS BIGINT), ROUND(coalesce(t2 / P, 0.0), 6), ROUND(coalesce(f2 / N, 0.0), 6) FROM s
UNION ALL SELECT 'rf_new_merchant', CAST(n3 AS BIGINT), ROUND(coalesce(t3 / P, 0.0), 6), ROUND(coalesce(f3 / N, 0.0), 6) FROM s""")
def agg30_pattern_detection(spark, sf):
    r = _rule(spark, sf)
    return rounded(ED.pattern_detection(r, ["rf_high_amount", "rf_unusual_time", "rf_new_merchant"]))


# ---------------------------------------------------------------- SCL11
@reg("scl11_different_location", """SELECT l.l_orderkey AS order_id, l.l_linenumber AS line, l.l_extendedprice AS amount,
  CAST(NOT (CAST(c.c_nationkey AS VARCHAR) IS NOT DISTINCT FROM CAST(s.s_nationkey AS VARCHAR))
       OR (c.c_nationkey IS NULL AND s.s_nationkey IS NULL) AS INTEGER) AS different_zip
FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey""")
def scl11_different_location(spark, sf):
    d = FT.location_features(tx_line_locations(spark, sf), city="customer_zip", state="merchant_zip")
    return d.select("order_id", "line", "amount", "different_zip")
