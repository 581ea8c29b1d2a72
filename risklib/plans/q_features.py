"""Feature queries (SCL*, CLN*, WIN*, AGG1-11, JN*, SCO1-4, FE1, FE2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklib.operators import advanced as A
from risklib.operators import features as FT
from risklib.plans.common import r6, rounded
from risklib.plans.sqlviews import EV, LINES, ORD, ORD_FULL
from risklib.schema import PAYMENT_COLUMNS
from risklib.sources.tables import tx_events, tx_lines, tx_orders, tx_orders_full

Q, SQL = {}, {}
HOME = "NATION_0"   # the home country of the tables' customers


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# --------------------------------------------------------------------------- WIN6 + WIN7
_VEL_SQL = EV + """, v AS (SELECT *, epoch_us(transaction_ts) AS us FROM tx_events),
c AS (SELECT transaction_id,
  CASE WHEN us IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY card_number ORDER BY us
       RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) END AS tx_count_1h,
  CASE WHEN us IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY card_number ORDER BY us
       RANGE BETWEEN 21600000000 PRECEDING AND 1 PRECEDING) END AS tx_count_6h,
  CASE WHEN us IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY card_number ORDER BY us
       RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) END AS tx_count_24h
  FROM v),
q AS (SELECT quantile_cont(tx_count_1h, 0.95) AS p1, quantile_cont(tx_count_6h, 0.95) AS p6,
             quantile_cont(tx_count_24h, 0.95) AS p24 FROM c)
"""


@reg("win6_velocity_windows", _VEL_SQL + """SELECT transaction_id, CAST(tx_count_1h AS BIGINT) AS tx_count_1h,
  CAST(tx_count_6h AS BIGINT) AS tx_count_6h, CAST(tx_count_24h AS BIGINT) AS tx_count_24h,
  CAST(tx_count_1h > p1 AS INTEGER) AS high_velocity_1h, CAST(tx_count_6h > p6 AS INTEGER) AS high_velocity_6h,
  CAST(tx_count_24h > p24 AS INTEGER) AS high_velocity_24h FROM c, q""")
def win6_velocity_windows(spark, sf):
    df = A.transaction_velocity_features(tx_events(spark, sf))
    return df.select("transaction_id", "tx_count_1h", "tx_count_6h", "tx_count_24h",
                     "high_velocity_1h", "high_velocity_6h", "high_velocity_24h")


@reg("win6_velocity_windows_probe", SQL["win6_velocity_windows"])
def win6_velocity_windows_probe(spark, sf):
    """Same counts through probe rows and 1-hour buckets (extreme-skew plan)."""
    df = A.transaction_velocity_features(tx_events(spark, sf), method="probe", bucket_hours=1)
    return df.select("transaction_id", "tx_count_1h", "tx_count_6h", "tx_count_24h",
                     "high_velocity_1h", "high_velocity_6h", "high_velocity_24h")


# --------------------------------------------------------------------------- SCL1/SCL2
@reg("scl2_amount_features", EV + """SELECT transaction_id, ROUND(ln(1 + amount), 6) AS amount_log,
  CASE WHEN amount > 0 AND amount <= 10 THEN 'very_small' WHEN amount > 10 AND amount <= 50 THEN 'small'
       WHEN amount > 50 AND amount <= 100 THEN 'medium' WHEN amount > 100 AND amount <= 500 THEN 'large'
       WHEN amount > 500 AND amount <= 1000 THEN 'very_large' WHEN amount > 1000 THEN 'huge' END AS amount_category
  FROM tx_events""")
def scl2_amount_features(spark, sf):
    return rounded(FT.amount_features(tx_events(spark, sf)).select("transaction_id", "amount_log", "amount_category"))


# --------------------------------------------------------------------------- SCL4-SCL8
_TEMP_SQL = EV + """SELECT transaction_id, CAST(hour(transaction_ts) AS INTEGER) AS hour_of_day,
  CAST(isodow(transaction_ts) - 1 AS INTEGER) AS day_of_week,
  CAST(isodow(transaction_ts) >= 6 AS INTEGER) AS is_weekend,
  CAST(month(transaction_ts) AS INTEGER) AS month, CAST(day(transaction_ts) AS INTEGER) AS day_of_month,
  CASE WHEN hour(transaction_ts) <= 6 THEN 'early_morning' WHEN hour(transaction_ts) <= 12 THEN 'morning'
       WHEN hour(transaction_ts) <= 18 THEN 'afternoon' WHEN hour(transaction_ts) <= 24 THEN 'evening' END AS period_of_day,
  CAST(hour(transaction_ts) < 6 OR hour(transaction_ts) >= 22 AS INTEGER) AS is_night_time
  FROM tx_events"""


@reg("scl4_temporal_features", _TEMP_SQL)
def scl4_temporal_features(spark, sf):
    return FT.temporal_features(tx_events(spark, sf)).select(
        "transaction_id", "hour_of_day", "day_of_week", "is_weekend", "month", "day_of_month",
        "period_of_day", "is_night_time")


# --------------------------------------------------------------------------- WIN3/WIN4/WIN5
_SEQ_SQL = EV + """, v AS (SELECT *, epoch_us(transaction_ts) AS us FROM tx_events),
s AS (SELECT transaction_id, amount, card_number, transaction_ts, us,
  lag(us) OVER (PARTITION BY card_number ORDER BY us, transaction_id) AS prev_us,
  lag(amount) OVER (PARTITION BY card_number ORDER BY us, transaction_id) AS prev_amount,
  row_number() OVER (PARTITION BY card_number ORDER BY us, transaction_id) AS rn,
  count(*) OVER (PARTITION BY card_number) AS card_rows,
  count(transaction_id) OVER (PARTITION BY card_number) AS card_cnt,
  avg(amount) OVER (PARTITION BY card_number) AS card_avg,
  avg(hour(transaction_ts)) OVER (PARTITION BY card_number) AS card_avg_hour,
  count(*) OVER (PARTITION BY card_number ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS c24
  FROM v)
"""


@reg("win5_velocity_features", _SEQ_SQL + """SELECT transaction_id,
  coalesce((us - prev_us) / 60000000.0, 99999.0) AS time_since_last_transaction,
  CAST(coalesce((us - prev_us) / 60000000.0, 99999.0) < 30 AS INTEGER) AS is_quick_transaction,
  CAST(CASE WHEN card_rows > 1 THEN c24 ELSE 0 END AS BIGINT) AS transaction_count_last_24h
  FROM s""")
def win5_velocity_features(spark, sf):
    return FT.velocity_features(tx_events(spark, sf)).select(
        "transaction_id", "time_since_last_transaction", "is_quick_transaction", "transaction_count_last_24h")


# --------------------------------------------------------------------------- AGG5/WIN1/WIN2
@reg("agg5_customer_behavior", _SEQ_SQL + """SELECT transaction_id,
  CAST(card_cnt AS BIGINT) AS customer_transaction_count, ROUND(card_avg, 6) AS customer_avg_amount,
  ROUND(CASE WHEN card_avg <> 0 THEN amount / card_avg END, 6) AS amount_deviation_from_avg,
  ROUND(amount - prev_amount, 6) AS amount_diff_last_transaction,
  CAST(rn = 1 AS INTEGER) AS is_first_transaction
  FROM s""")
def agg5_customer_behavior(spark, sf):
    return rounded(FT.customer_behavior_features(tx_events(spark, sf)).select(
        "transaction_id", "customer_transaction_count", "customer_avg_amount", "amount_deviation_from_avg",
        "amount_diff_last_transaction", "is_first_transaction"))


# --------------------------------------------------------------------------- WIN8/AGG9/SCL14
@reg("win8_fraud_patterns", _SEQ_SQL + """SELECT transaction_id,
  ROUND(CASE WHEN prev_amount <> 0 THEN amount / prev_amount END, 6) AS amount_ratio_to_previous,
  CAST(coalesce(CASE WHEN prev_amount <> 0 THEN amount / prev_amount END > 5
       OR (prev_amount = 0 AND amount > 0), false) AS INTEGER) AS high_amount_increase,
  CAST(least(abs(hour(transaction_ts) - card_avg_hour), 24 - abs(hour(transaction_ts) - card_avg_hour)) > 6
       AS INTEGER) AS unusual_hour_for_customer
  FROM s""")
def win8_fraud_patterns(spark, sf):
    df = FT.fraud_pattern_features(FT.temporal_features(tx_events(spark, sf)))
    return rounded(df.select("transaction_id", "amount_ratio_to_previous", "high_amount_increase",
                             "unusual_hour_for_customer"))


# --------------------------------------------------------------------------- AGG1/AGG2/WIN10/WIN11/JN1
def _loc_sql(key: str, k: int, out: str) -> str:
    return f"""{out}_g AS (SELECT {key}, avg(fraud_indicator) AS r, count(fraud_indicator) AS n FROM tx_orders GROUP BY {key}),
{out}_rows AS (SELECT o.transaction_id, coalesce(CASE WHEN g.n >= {k} THEN g.r END, (SELECT avg(fraud_indicator) FROM tx_orders)) AS {out}
  FROM tx_orders o LEFT JOIN {out}_g g ON o.{key} = g.{key}),
{out}_e AS (SELECT quantile_cont({out}, [0, 0.25, 0.5, 0.75, 1]) AS e FROM {out}_rows),
{out}_cat AS (SELECT transaction_id, {out},
  CASE WHEN e[1] < e[2] AND e[2] < e[3] AND e[3] < e[4] AND e[4] < e[5] THEN
    CASE WHEN {out} >= e[1] AND {out} <= e[2] THEN 'low_risk' WHEN {out} > e[2] AND {out} <= e[3] THEN 'medium_low_risk'
         WHEN {out} > e[3] AND {out} <= e[4] THEN 'medium_high_risk' WHEN {out} > e[4] AND {out} <= e[5] THEN 'high_risk' END
  ELSE
    CASE WHEN {out} > 0 AND {out} <= 0.01 THEN 'low_risk' WHEN {out} > 0.01 AND {out} <= 0.05 THEN 'medium_low_risk'
         WHEN {out} > 0.05 AND {out} <= 0.10 THEN 'medium_high_risk' WHEN {out} > 0.10 AND {out} <= 1.0 THEN 'high_risk' END
  END AS cat
  FROM {out}_rows, {out}_e)"""


@reg("agg1_location_features", ORD.rstrip() + ",\n" + _loc_sql("merchant_city", 5, "city_fraud_rate") + ",\n"
     + _loc_sql("merchant_state", 10, "state_fraud_rate") + """
SELECT c.transaction_id, ROUND(c.city_fraud_rate, 6) AS city_fraud_rate, c.cat AS city_risk_category,
  ROUND(s.state_fraud_rate, 6) AS state_fraud_rate, s.cat AS state_risk_category,
  CAST(coalesce(c.cat = 'high_risk', false) AS INTEGER) AS high_risk_location
FROM city_fraud_rate_cat c JOIN state_fraud_rate_cat s ON c.transaction_id = s.transaction_id""")
def agg1_location_features(spark, sf):
    return rounded(FT.location_features(tx_orders(spark, sf)).select(
        "transaction_id", "city_fraud_rate", "city_risk_category", "state_fraud_rate", "state_risk_category",
        "high_risk_location"))


# --------------------------------------------------------------------------- AGG3/WIN10 (merchant)
def _merchant_sql(src: str) -> str:
    """Per row of ``src``: merchant count, mean, rate and risk category (``merchant_rows``)."""
    return f""", mg AS (SELECT merchant_id, count(*) AS cnt, avg(amount) AS a,
   avg(fraud_indicator) AS r FROM {src} GROUP BY merchant_id),
mr AS (SELECT t.*, g.cnt, g.a, g.r, least(greatest(g.r, 0.0), 1.0) AS rc
   FROM {src} t LEFT JOIN mg g ON t.merchant_id = g.merchant_id),
me AS (SELECT quantile_cont(rc, [0, 0.25, 0.5, 0.75, 1]) AS e, quantile_cont(rc, 0.5) AS med,
   count(DISTINCT rc) AS u FROM mr WHERE merchant_id IS NOT NULL),
merchant_rows AS (SELECT mr.* EXCLUDE (cnt, a, r, rc), CAST(cnt AS BIGINT) AS merchant_transaction_count,
  ROUND(a, 6) AS merchant_avg_amount, ROUND(r, 6) AS merchant_fraud_rate,
  CASE WHEN merchant_id IS NULL THEN NULL WHEN u >= 4 THEN
     CASE WHEN e[1] < e[2] AND e[2] < e[3] AND e[3] < e[4] AND e[4] < e[5] THEN
       CASE WHEN rc >= e[1] AND rc <= e[2] THEN 'low_risk' WHEN rc > e[2] AND rc <= e[3] THEN 'medium_low_risk'
            WHEN rc > e[3] AND rc <= e[4] THEN 'medium_high_risk' WHEN rc > e[4] AND rc <= e[5] THEN 'high_risk' END
     ELSE CASE WHEN rc <= med / 2 THEN 'low_risk' WHEN rc <= med THEN 'medium_low_risk'
               WHEN rc <= med * 1.5 THEN 'medium_high_risk' ELSE 'high_risk' END END
  WHEN u <= 2 THEN CASE WHEN rc <= med THEN 'low_risk' ELSE 'high_risk' END
  ELSE CASE WHEN rc <= med * 0.5 THEN 'low_risk' WHEN rc <= med * 1.5 THEN 'medium_risk' ELSE 'high_risk' END
  END AS merchant_risk_category
FROM mr, me)"""


MERCHANT_COLS = ["merchant_transaction_count", "merchant_avg_amount", "merchant_fraud_rate", "merchant_risk_category"]


@reg("agg3_merchant_features", LINES + _merchant_sql("tx_lines") + """
SELECT merchant_id, ROUND(amount, 6) AS amount, merchant_transaction_count, merchant_avg_amount, merchant_fraud_rate,
  merchant_risk_category FROM merchant_rows""")
def agg3_merchant_features(spark, sf):
    df = tx_lines(spark, sf, with_location=False)
    out = FT.merchant_features(df).select("merchant_id", "amount", "merchant_transaction_count",
                                          "merchant_avg_amount", "merchant_fraud_rate", "merchant_risk_category")
    return rounded(out)


# --------------------------------------------------------------------------- AGG4/JN4/SCL12/SCL13
def _payment_sql(src: str) -> str:
    """Per row of ``src``: the rate of each payment value, the combination and the foreign flag (``payment_rows``)."""
    rates = ", ".join(f"ROUND(r_{c}.r, 6) AS {c}_fraud_rate" for c in PAYMENT_COLUMNS)
    joins = "\n".join(f"LEFT JOIN (SELECT {c}, avg(fraud_indicator) AS r FROM {src} GROUP BY 1) r_{c} ON t.{c} = r_{c}.{c}"
                      for c in PAYMENT_COLUMNS)
    return f""", payment_rows AS (SELECT t.transaction_id, {rates},
  t.payment_method || '_' || t.capture_method AS payment_capture_combo,
  CAST(t.issuer_country IS DISTINCT FROM '{HOME}' AS INTEGER) AS is_international
FROM {src} t {joins})"""


PAYMENT_COLS = [f"{c}_fraud_rate" for c in PAYMENT_COLUMNS] + ["payment_capture_combo", "is_international"]


@reg("agg4_payment_features", ORD_FULL.rstrip() + _payment_sql("tx_orders_full") + " SELECT * FROM payment_rows")
def agg4_payment_features(spark, sf):
    df = FT.payment_method_features(tx_orders_full(spark, sf), home_country=HOME)
    return rounded(df.select("transaction_id", *PAYMENT_COLS))


# --------------------------------------------------------------------------- AGG10/AGG6/JN3/SCO1
_BEH_SQL = EV + """, st AS (SELECT card_number, avg(amount) AS m, stddev_samp(amount) AS sd FROM tx_events GROUP BY 1),
mc AS (SELECT card_number, mcc, count(*) AS c FROM tx_events WHERE mcc IS NOT NULL GROUP BY 1, 2),
mt AS (SELECT card_number, sum(c) AS tot FROM mc GROUP BY 1),
b AS (SELECT t.transaction_id,
   CASE WHEN st.sd > 0 THEN (t.amount - st.m) / st.sd ELSE 0.0 END AS z,
   CAST(mc.c AS DOUBLE) / mt.tot AS f
 FROM tx_events t JOIN st ON t.card_number = st.card_number
 LEFT JOIN mc ON t.card_number = mc.card_number AND t.mcc = mc.mcc
 LEFT JOIN mt ON t.card_number = mt.card_number)
"""


@reg("agg10_behavior_patterns", _BEH_SQL + """SELECT transaction_id, ROUND(z, 6) AS amount_zscore,
  CAST(abs(z) > 2.5 AS INTEGER) AS unusual_amount, ROUND(coalesce(f, 0.0), 6) AS mcc_frequency,
  CASE WHEN f IS NULL THEN 1 ELSE CAST(f < 0.1 AS INTEGER) END AS unusual_mcc,
  ROUND(CAST(abs(z) > 2.5 AS INTEGER) * 0.6 + (CASE WHEN f IS NULL THEN 1 ELSE CAST(f < 0.1 AS INTEGER) END) * 0.4, 6)
    AS behavior_risk_score
  FROM b""")
def agg10_behavior_patterns(spark, sf):
    df = A.behavioral_pattern_features(tx_events(spark, sf))
    return rounded(df.select("transaction_id", "amount_zscore", "unusual_amount", "mcc_frequency", "unusual_mcc",
                             "behavior_risk_score"))


# --------------------------------------------------------------------------- AGG7/AGG8/SCO2/SCL10
_TP_SQL = EV + """, h AS (SELECT transaction_id, card_number, CAST(hour(transaction_ts) AS INTEGER) AS hour,
   CAST(day(transaction_ts) AS INTEGER) AS day, CAST(isodow(transaction_ts) - 1 AS INTEGER) AS day_of_week
   FROM tx_events),
hc AS (SELECT card_number, hour, count(*) AS c FROM h WHERE hour IS NOT NULL GROUP BY 1, 2),
ht AS (SELECT card_number, sum(c) AS tot FROM hc GROUP BY 1),
dc AS (SELECT card_number, day_of_week, count(*) AS c FROM h WHERE day_of_week IS NOT NULL GROUP BY 1, 2),
tp AS (SELECT h.*, CAST(h.day_of_week >= 5 AS INTEGER) AS is_weekend,
   CASE WHEN h.hour <= 6 THEN 'madrugada' WHEN h.hour <= 12 THEN 'manha' WHEN h.hour <= 18 THEN 'tarde'
        WHEN h.hour <= 24 THEN 'noite' END AS period_of_day,
   coalesce(CAST(hc.c AS DOUBLE) / ht.tot, 0.0) AS hour_frequency,
   coalesce(CAST(dc.c AS DOUBLE) / ht.tot, 0.0) AS dow_frequency
 FROM h LEFT JOIN hc ON h.card_number = hc.card_number AND h.hour = hc.hour
 LEFT JOIN ht ON h.card_number = ht.card_number
 LEFT JOIN dc ON h.card_number = dc.card_number AND h.day_of_week = dc.day_of_week)
"""


@reg("agg7_temporal_patterns", _TP_SQL + """SELECT transaction_id, hour, day, day_of_week, is_weekend, period_of_day,
  ROUND(hour_frequency, 6) AS hour_frequency, CAST(hour_frequency < 0.05 AS INTEGER) AS unusual_hour,
  ROUND(dow_frequency, 6) AS dow_frequency, CAST(dow_frequency < 0.05 AS INTEGER) AS unusual_day,
  ROUND(CAST(hour_frequency < 0.05 AS INTEGER) * 0.7 + CAST(dow_frequency < 0.05 AS INTEGER) * 0.3, 6) AS temporal_risk_score,
  CAST(period_of_day IN ('madrugada', 'noite') AND is_weekend = 1 AS INTEGER) AS high_risk_time_pattern
  FROM tp""")
def agg7_temporal_patterns(spark, sf):
    df = A.temporal_pattern_features(tx_events(spark, sf))
    return rounded(df.select("transaction_id", "hour", "day", "day_of_week", "is_weekend", "period_of_day",
                             "hour_frequency", "unusual_hour", "dow_frequency", "unusual_day",
                             "temporal_risk_score", "high_risk_time_pattern"))


# --------------------------------------------------------------------------- FE2
def _body(sql: str) -> str:
    return sql[len(EV):]


_FE2_SQL = (EV + _body(_VEL_SQL) + _body(_BEH_SQL) + _body(_TP_SQL)
            + """, f AS (SELECT c.transaction_id, c.tx_count_1h, c.tx_count_6h, c.tx_count_24h,
    CAST(c.tx_count_1h > q.p1 AS INTEGER) AS high_velocity_1h, CAST(c.tx_count_6h > q.p6 AS INTEGER) AS high_velocity_6h,
    CAST(c.tx_count_24h > q.p24 AS INTEGER) AS high_velocity_24h,
    b.z AS amount_zscore, CAST(abs(b.z) > 2.5 AS INTEGER) AS unusual_amount, coalesce(b.f, 0.0) AS mcc_frequency,
    CASE WHEN b.f IS NULL THEN 1 ELSE CAST(b.f < 0.1 AS INTEGER) END AS unusual_mcc,
    tp.hour, tp.day, tp.day_of_week, tp.is_weekend, tp.period_of_day, tp.hour_frequency,
    CAST(tp.hour_frequency < 0.05 AS INTEGER) AS unusual_hour, tp.dow_frequency,
    CAST(tp.dow_frequency < 0.05 AS INTEGER) AS unusual_day,
    CAST(tp.period_of_day IN ('madrugada', 'noite') AND tp.is_weekend = 1 AS INTEGER) AS high_risk_time_pattern
  FROM c, q, b, tp WHERE c.transaction_id = b.transaction_id AND c.transaction_id = tp.transaction_id),
s AS (SELECT *, unusual_amount * 0.6 + unusual_mcc * 0.4 AS behavior_risk_score,
    unusual_hour * 0.7 + unusual_day * 0.3 AS temporal_risk_score,
    ROUND((unusual_amount * 0.25 + unusual_mcc * 0.15 + unusual_hour * 0.20 + unusual_day * 0.10
     + high_risk_time_pattern * 0.15 + high_velocity_24h * 0.15) * 100, 6) AS fraud_risk_score FROM f)
SELECT transaction_id, CAST(tx_count_1h AS BIGINT) AS tx_count_1h, CAST(tx_count_6h AS BIGINT) AS tx_count_6h,
  CAST(tx_count_24h AS BIGINT) AS tx_count_24h, high_velocity_1h, high_velocity_6h, high_velocity_24h,
  ROUND(amount_zscore, 6) AS amount_zscore, unusual_amount, ROUND(mcc_frequency, 6) AS mcc_frequency, unusual_mcc,
  ROUND(behavior_risk_score, 6) AS behavior_risk_score, hour, day, day_of_week, is_weekend, period_of_day,
  ROUND(hour_frequency, 6) AS hour_frequency, unusual_hour, ROUND(dow_frequency, 6) AS dow_frequency, unusual_day,
  ROUND(temporal_risk_score, 6) AS temporal_risk_score, high_risk_time_pattern,
  ROUND(fraud_risk_score, 6) AS fraud_risk_score,
  CASE WHEN fraud_risk_score >= 0 AND fraud_risk_score <= 25 THEN 'baixo' WHEN fraud_risk_score > 25 AND fraud_risk_score <= 50 THEN 'medio'
       WHEN fraud_risk_score > 50 AND fraud_risk_score <= 75 THEN 'alto' WHEN fraud_risk_score > 75 AND fraud_risk_score <= 100 THEN 'muito_alto' END AS risk_category
FROM s""")

FE2_ROWS_SQL = _FE2_SQL.rsplit("SELECT transaction_id, CAST(tx_count_1h", 1)[0]  # ends with the unrounded rows ``s``
FE2_COLS = ["transaction_id", "tx_count_1h", "tx_count_6h", "tx_count_24h", "high_velocity_1h", "high_velocity_6h",
            "high_velocity_24h", "amount_zscore", "unusual_amount", "mcc_frequency", "unusual_mcc",
            "behavior_risk_score", "hour", "day", "day_of_week", "is_weekend", "period_of_day", "hour_frequency",
            "unusual_hour", "dow_frequency", "unusual_day", "temporal_risk_score", "high_risk_time_pattern",
            "fraud_risk_score", "risk_category"]


@reg("fe2_advanced_features", _FE2_SQL)
def fe2_advanced_features(spark, sf):
    return rounded(A.create_all_advanced_features(tx_events(spark, sf)).select(*FE2_COLS))


@reg("sco3_fraud_risk_score", FE2_ROWS_SQL + """SELECT transaction_id, ROUND(fraud_risk_score, 6) AS fraud_risk_score,
  CASE WHEN fraud_risk_score >= 0 AND fraud_risk_score <= 25 THEN 'baixo' WHEN fraud_risk_score > 25 AND fraud_risk_score <= 50 THEN 'medio'
       WHEN fraud_risk_score > 50 AND fraud_risk_score <= 75 THEN 'alto' WHEN fraud_risk_score > 75 AND fraud_risk_score <= 100 THEN 'muito_alto' END AS risk_category
FROM s""")
def sco3_fraud_risk_score(spark, sf):
    return rounded(A.create_all_advanced_features(tx_events(spark, sf)).select(
        "transaction_id", "fraud_risk_score", "risk_category"))


# --------------------------------------------------------------------------- FE1 (on tx_orders_full)
def _seq_ctes(src: str) -> str:
    return f""", v AS (SELECT *, epoch_us(transaction_ts) AS us FROM {src}),
s AS (SELECT transaction_id, amount, card_number, transaction_ts, us,
  lag(us) OVER (PARTITION BY card_number ORDER BY us, transaction_id) AS prev_us,
  lag(amount) OVER (PARTITION BY card_number ORDER BY us, transaction_id) AS prev_amount,
  row_number() OVER (PARTITION BY card_number ORDER BY us, transaction_id) AS rn,
  count(*) OVER (PARTITION BY card_number) AS card_rows,
  count(transaction_id) OVER (PARTITION BY card_number) AS card_cnt,
  avg(amount) OVER (PARTITION BY card_number) AS card_avg,
  avg(hour(transaction_ts)) OVER (PARTITION BY card_number) AS card_avg_hour,
  count(*) OVER (PARTITION BY card_number ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS c24
  FROM v)"""


_FE1_SQL = (ORD_FULL.rstrip() + ",\n" + _loc_sql("merchant_city", 5, "city_fraud_rate") + ",\n"
            + _loc_sql("merchant_state", 10, "state_fraud_rate") + _seq_ctes("tx_orders")
            + _merchant_sql("tx_orders_full") + _payment_sql("tx_orders_full") + """
SELECT s.transaction_id, CAST(hour(s.transaction_ts) AS INTEGER) AS hour_of_day,
  CAST(isodow(s.transaction_ts) - 1 AS INTEGER) AS day_of_week, CAST(isodow(s.transaction_ts) >= 6 AS INTEGER) AS is_weekend,
  CAST(month(s.transaction_ts) AS INTEGER) AS month, CAST(day(s.transaction_ts) AS INTEGER) AS day_of_month,
  CASE WHEN hour(s.transaction_ts) <= 6 THEN 'early_morning' WHEN hour(s.transaction_ts) <= 12 THEN 'morning'
       WHEN hour(s.transaction_ts) <= 18 THEN 'afternoon' WHEN hour(s.transaction_ts) <= 24 THEN 'evening' END AS period_of_day,
  CAST(hour(s.transaction_ts) < 6 OR hour(s.transaction_ts) >= 22 AS INTEGER) AS is_night_time,
  ROUND(ln(1 + s.amount), 6) AS amount_log,
  CASE WHEN s.amount > 0 AND s.amount <= 10 THEN 'very_small' WHEN s.amount > 10 AND s.amount <= 50 THEN 'small'
       WHEN s.amount > 50 AND s.amount <= 100 THEN 'medium' WHEN s.amount > 100 AND s.amount <= 500 THEN 'large'
       WHEN s.amount > 500 AND s.amount <= 1000 THEN 'very_large' WHEN s.amount > 1000 THEN 'huge' END AS amount_category,
  ROUND(c.city_fraud_rate, 6) AS city_fraud_rate, c.cat AS city_risk_category,
  ROUND(st.state_fraud_rate, 6) AS state_fraud_rate, st.cat AS state_risk_category,
  CAST(coalesce(c.cat = 'high_risk', false) AS INTEGER) AS high_risk_location,
  CAST(s.card_cnt AS BIGINT) AS customer_transaction_count, ROUND(s.card_avg, 6) AS customer_avg_amount,
  ROUND(CASE WHEN s.card_avg <> 0 THEN s.amount / s.card_avg END, 6) AS amount_deviation_from_avg,
  ROUND(s.amount - s.prev_amount, 6) AS amount_diff_last_transaction, CAST(s.rn = 1 AS INTEGER) AS is_first_transaction,
  ROUND(coalesce((s.us - s.prev_us) / 60000000.0, 99999.0), 6) AS time_since_last_transaction,
  CAST(coalesce((s.us - s.prev_us) / 60000000.0, 99999.0) < 30 AS INTEGER) AS is_quick_transaction,
  CAST(CASE WHEN s.card_rows > 1 THEN s.c24 ELSE 0 END AS BIGINT) AS transaction_count_last_24h,
  ROUND(CASE WHEN s.prev_amount <> 0 THEN s.amount / s.prev_amount END, 6) AS amount_ratio_to_previous,
  CAST(coalesce(CASE WHEN s.prev_amount <> 0 THEN s.amount / s.prev_amount END > 5
       OR (s.prev_amount = 0 AND s.amount > 0), false) AS INTEGER) AS high_amount_increase,
  CAST(least(abs(hour(s.transaction_ts) - s.card_avg_hour), 24 - abs(hour(s.transaction_ts) - s.card_avg_hour)) > 6
       AS INTEGER) AS unusual_hour_for_customer,
  m.merchant_transaction_count, m.merchant_avg_amount, m.merchant_fraud_rate, m.merchant_risk_category,
  p.* EXCLUDE (transaction_id)
FROM s JOIN merchant_rows m ON s.transaction_id = m.transaction_id
       JOIN payment_rows p ON s.transaction_id = p.transaction_id
       JOIN city_fraud_rate_cat c ON s.transaction_id = c.transaction_id
       JOIN state_fraud_rate_cat st ON s.transaction_id = st.transaction_id""")

FE1_COLS = ["transaction_id", "hour_of_day", "day_of_week", "is_weekend", "month", "day_of_month", "period_of_day",
            "is_night_time", "amount_log", "amount_category", "city_fraud_rate", "city_risk_category",
            "state_fraud_rate", "state_risk_category", "high_risk_location", "customer_transaction_count",
            "customer_avg_amount", "amount_deviation_from_avg", "amount_diff_last_transaction",
            "is_first_transaction", "time_since_last_transaction", "is_quick_transaction",
            "transaction_count_last_24h", "amount_ratio_to_previous", "high_amount_increase",
            "unusual_hour_for_customer", *MERCHANT_COLS, *PAYMENT_COLS]


@reg("fe1_all_features", _FE1_SQL)
def fe1_all_features(spark, sf):
    return rounded(FT.create_all_features(tx_orders_full(spark, sf), home_country=HOME).select(*FE1_COLS))
