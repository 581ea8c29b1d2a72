"""Streaming queries (STR1-STR7): run with availableNow into parquet, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklib.plans.common import rounded
from risklib.plans.sqlviews import EV
from risklib.sources.tables import read_table, tx_events
from risklib.streaming import ops as S
from risklib.streaming.card_state import card_state_features

Q, SQL = {}, {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


_WM = "(SELECT max(transaction_ts) FROM tx_events) - INTERVAL 1 HOUR"


@reg("str1_window_kpis", EV + f"""SELECT strftime(time_bucket(INTERVAL 1 HOUR, transaction_ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(time_bucket(INTERVAL 1 HOUR, transaction_ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
  count(*) AS transactions, CAST(sum(fraud_indicator) AS BIGINT) AS fraud_count,
  ROUND(avg(fraud_indicator), 6) AS fraud_rate, ROUND(avg(amount), 6) AS avg_amount
FROM tx_events GROUP BY time_bucket(INTERVAL 1 HOUR, transaction_ts)
HAVING time_bucket(INTERVAL 1 HOUR, transaction_ts) + INTERVAL 1 HOUR <= {_WM}""")
def str1_window_kpis(spark, sf):
    p = S.run_to_parquet(S.window_kpis(S.event_stream(spark, sf)), "str1")
    d = spark.read.parquet(p)
    return rounded(d.withColumn("window_start", _ts("window_start")).withColumn("window_end", _ts("window_end")))


@reg("str2_sliding_velocity", EV + f""", w AS (SELECT card_number, amount,
   time_bucket(INTERVAL 1 HOUR, transaction_ts) - unnest(generate_series(0, 23)) * INTERVAL 1 HOUR AS ws FROM tx_events)
SELECT card_number, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(ws + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS transactions,
  ROUND(sum(amount), 6) AS total_amount FROM w GROUP BY card_number, ws HAVING ws + INTERVAL 24 HOUR <= {_WM}""")
def str2_sliding_velocity(spark, sf):
    rows = read_table(spark, sf, "events").count()
    p = S.run_to_parquet(S.sliding_velocity(S.event_stream(S.state_session(spark, rows), sf), groups=S.card_groups(rows)), "str2")
    d = spark.read.parquet(p)
    return rounded(d.withColumn("window_start", _ts("window_start")).withColumn("window_end", _ts("window_end")))


@reg("str3_card_sessions", EV + f""", g AS (SELECT *, CASE WHEN lag(transaction_ts) OVER (PARTITION BY card_number ORDER BY transaction_ts)
      > transaction_ts - INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new_s FROM tx_events),
s AS (SELECT *, sum(new_s) OVER (PARTITION BY card_number ORDER BY transaction_ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT card_number, strftime(min(transaction_ts), '%Y-%m-%d %H:%M:%S') AS session_start,
  strftime(max(transaction_ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS transactions,
  ROUND(sum(amount), 6) AS total_amount FROM s GROUP BY card_number, sid
HAVING max(transaction_ts) + INTERVAL 30 MINUTE <= {_WM}""")
def str3_card_sessions(spark, sf):
    p = S.run_to_parquet(S.card_sessions(S.event_stream(spark, sf)), "str3")
    d = spark.read.parquet(p)
    return rounded(d.withColumn("session_start", _ts("session_start")).withColumn("session_end", _ts("session_end")))


@reg("str4_stateful_card_features", EV + """, v AS (SELECT *, epoch_us(transaction_ts) AS us FROM tx_events),
s AS (SELECT transaction_id, card_number, amount, us,
   lag(us) OVER w AS pu, lag(amount) OVER w AS pa,
   count(*) OVER (PARTITION BY card_number ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb,
   sum(CAST(round(amount * 100) AS BIGINT)) OVER (PARTITION BY card_number ORDER BY us, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sb,
   count(*) OVER (PARTITION BY card_number ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS c24
   FROM v WINDOW w AS (PARTITION BY card_number ORDER BY us, transaction_id))
SELECT transaction_id, card_number, coalesce((us - pu) / 60000000.0, 99999.0) AS minutes_since_last,
  amount - pa AS amount_diff, CASE WHEN nb > 0 THEN CAST(sb AS DOUBLE) / 100.0 / nb END AS history_mean_amount,
  c24 AS tx_count_24h FROM s""")
def str4_stateful_card_features(spark, sf):
    """Replayed one day per micro-batch, so the state carries over many batches."""
    events = read_table(spark, sf, "events")
    src = S.replay_by_day(spark, events, "str4-days")
    rows = events.count()
    states = S.state_session(spark, rows)
    p = S.run_to_parquet(S.stateful_card_features(S.event_stream(states, src, None, files_per_batch=1), groups=S.card_groups(rows)), "str4")
    return spark.read.parquet(p)


@reg("str4_card_state_processor", SQL["str4_stateful_card_features"])
def str4_card_state_processor(spark, sf):
    """The same features from value and map states with event-time timers, replayed five days per micro-batch."""
    events = read_table(spark, sf, "events")
    src = S.replay_by_day(spark, events, "str4-hours")
    rows = events.count()
    states = S.state_session(spark, rows)
    p = S.run_to_parquet(card_state_features(S.event_stream(states, src, None, files_per_batch=5), groups=S.card_groups(rows)), "str4-processor")
    return spark.read.parquet(p)


@reg("str5_stream_alerts", EV + """, prof AS (SELECT card_number, avg(amount) AS pa FROM tx_events GROUP BY 1),
r AS (SELECT t.transaction_id, t.amount, CAST(t.amount > 1000 AS INTEGER) + CAST(hour(t.transaction_ts) < 5 OR hour(t.transaction_ts) > 22 AS INTEGER) AS k,
   prof.pa FROM tx_events t LEFT JOIN prof ON t.card_number = prof.card_number)
SELECT transaction_id, ROUND(least(0.05 + 0.15 * k, 0.99), 6) AS fraud_probability,
  ROUND(CASE WHEN pa <> 0 THEN amount / pa END, 6) AS amount_to_profile_ratio
FROM r WHERE least(0.05 + 0.15 * k, 0.99) >= 0.15""")
def str5_stream_alerts(spark, sf):
    profile = S.card_profile(tx_events(spark, sf))
    alerts = S.score_stream(S.event_stream(spark, sf), profile, threshold=0.15)
    p = S.run_foreach_batch(alerts.select("transaction_id", "fraud_probability", "amount_to_profile_ratio"),
                            "str5", S.write_alerts)
    return rounded(spark.read.parquet(p).drop("epoch"))


@reg("str6_dedup_replay", EV + "SELECT transaction_id, amount FROM tx_events")
def str6_dedup_replay(spark, sf):
    s = S.event_stream(spark, sf)
    replay = s.unionByName(S.event_stream(spark, sf))
    p = S.run_to_parquet(S.dedup_events(replay).select("transaction_id", "amount"), "str6")
    return spark.read.parquet(p)


@reg("str7_late_data_report", """WITH p AS (SELECT 1 AS run, ts FROM events WHERE ts >= TIMESTAMP '2024-01-16'
  UNION ALL SELECT 2, ts FROM events WHERE ts < TIMESTAMP '2024-01-16'),
m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM p WHERE run = 1)
SELECT CAST(run AS INTEGER) AS run, count(*) AS input_rows,
  CAST(sum(CASE WHEN run = 2 AND ts < (SELECT mark FROM m) THEN 1 ELSE 0 END) AS BIGINT) AS late_rows,
  CAST(sum(CASE WHEN run = 2 AND ts < (SELECT mark FROM m) THEN 0 ELSE 1 END) AS BIGINT) AS on_time_rows
FROM p GROUP BY run""")
def str7_late_data_report(spark, sf):
    return S.late_data_report(spark, sf)
