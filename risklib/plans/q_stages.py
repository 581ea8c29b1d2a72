"""Saved pipelines scoring batches and streams (PRP2, REG2, SCO8, STR5), distinct counts by sketches, and forms of earlier operators
that no other query runs (AGG18 wide, AGG25 latency, AGG29 minutes, SRC2, CLN5, SNK3)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from risklib.ml import stages as ST
from risklib.ml.registry import ModelRegistry
from risklib.operators import distinct as DI
from risklib.operators import eda as ED
from risklib.operators import features as FT
from risklib.operators import prep as PR
from risklib.operators.keyed import written
from risklib.plans.common import rounded
from risklib.plans.sqlviews import EV, ORD, SC
from risklib.session import scratch_path
from risklib.sources.files import read_upload_csv
from risklib.sources.tables import scored, tx_events, tx_orders
from risklib.streaming import ops as S

Q, SQL = {}, {}
NUMERIC, OTHER = ["amount", "mcc", "hour", "weekday"], ["band"]


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _raw(t):
    """Raw columns that a row has by itself, in a batch and in a stream."""
    return t.select("transaction_id", "fraud_indicator", "amount", "mcc", F.hour("transaction_ts").alias("hour"),
                    F.weekday("transaction_ts").alias("weekday"), F.when(F.col("amount") > 100, "high").when(F.col("amount") > 20, "middle").alias("band"))


def _fitted(spark, sf, classifier, balance):
    """A pipeline fitted on the training rows, its saved copy, and all rows."""
    rows = _raw(tx_events(spark, sf))
    train = written(PR.stratified_split(rows, "transaction_id").where("is_test = 0").drop("is_test"), "pipeline-train")
    model = ST.training_pipeline(classifier, NUMERIC, OTHER, balance).fit(train)
    path = scratch_path(spark, "pipeline-model")
    model.write().overwrite().save(path)
    return model, PipelineModel.load(path), rows


# ---------------------------------------------------------------- PRP2/SCO8 in model form
@reg("prp2_pipeline_batch_and_stream", EV + "SELECT transaction_id, 1 AS same_loaded, 1 AS same_streamed FROM tx_events")
def prp2_pipeline_batch_and_stream(spark, sf):
    """Preparation, SMOTE and boosted trees as one saved object: the fitted, the loaded and the streamed scores of every row are equal."""
    model, loaded, rows = _fitted(spark, sf, GBTClassifier(maxIter=10, maxDepth=4, seed=42), "smote")
    a = ST.score_rows(model, rows).select("transaction_id", F.col("fraud_probability").alias("_a"))
    b = ST.score_rows(loaded, rows).select("transaction_id", F.col("fraud_probability").alias("_b"))
    stream = ST.score_rows(loaded, _raw(S.event_stream(spark, sf))).select("transaction_id", "fraud_probability")
    c = spark.read.parquet(S.run_to_parquet(stream, "pipeline-stream")).withColumnRenamed("fraud_probability", "_c")
    return a.join(b, "transaction_id").join(c, "transaction_id").select(
        "transaction_id", (F.col("_a") == F.col("_b")).cast("int").alias("same_loaded"), (F.col("_b") == F.col("_c")).cast("int").alias("same_streamed"))


@reg("sco8_model_batch_scoring", EV + """SELECT count(*) AS total_transactions, count(*) AS probabilities, 1 AS decided_by_threshold, 1 AS shares_agree
FROM tx_events""")
def sco8_model_batch_scoring(spark, sf):
    """Batch scoring with the loaded pipeline: every row has a probability, and decision and summary follow from it."""
    from risklib.operators.scores import batch_summary
    _, loaded, rows = _fitted(spark, sf, LogisticRegression(), "random")
    out = ST.score_rows(loaded, rows, 0.6).select("transaction_id", "fraud_probability", "is_fraud").checkpoint()
    s = batch_summary(out, threshold=0.6).first()
    return out.agg(F.count(F.lit(1)).alias("total_transactions"), F.count_if(F.col("fraud_probability").between(0, 1)).alias("probabilities"),
                   F.min(((F.col("fraud_probability") >= 0.6).cast("int") == F.col("is_fraud")).cast("int")).alias("decided_by_threshold"),
                   (F.abs(F.avg("is_fraud") - F.lit(s["flagged_share"])) < 1e-12).cast("int").alias("shares_agree"))


@reg("str5_model_alerts", EV + "SELECT fraud_indicator, count(*) AS n_rows, 0 AS only_batch, 0 AS only_stream FROM tx_events GROUP BY 1")
def str5_model_alerts(spark, sf):
    """Alerts of the loaded pipeline on the stream, written by micro-batch, against the batch's: neither has one that the other lacks."""
    _, loaded, rows = _fitted(spark, sf, LogisticRegression(), "none")
    batch = ST.score_rows(loaded, rows, 0.2)
    alerts = ST.score_rows(loaded, _raw(S.event_stream(spark, sf)), 0.2).where("is_fraud = 1").select("transaction_id", "fraud_probability")
    streamed = spark.read.parquet(S.run_foreach_batch(alerts, "model-alerts", S.write_alerts)).select(
        "transaction_id", F.col("fraud_probability").alias("_p"))
    both = batch.join(streamed, "transaction_id", "left")
    flagged = F.col("is_fraud") == 1
    return both.groupBy("fraud_indicator").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(flagged & ~F.col("_p").eqNullSafe(F.col("fraud_probability"))).alias("only_batch"),
        F.count_if(~flagged & F.col("_p").isNotNull()).alias("only_stream"))


@reg("reg2_load_pipeline", EV + "SELECT transaction_id, 1 AS same FROM tx_events")
def reg2_load_pipeline(spark, sf):
    """REG2: a pipeline loaded from the registry by its id scores as the registered one."""
    model, _, rows = _fitted(spark, sf, LogisticRegression(), "none")
    registry = ModelRegistry(spark, scratch_path(spark, "pipeline-registry"))
    found = registry.load_model(registry.register_model(model, "pipeline", "pipeline", {"roc_auc": 0.5}, NUMERIC + OTHER))

    def p(m, name):
        return m.transform(rows).select("transaction_id", vector_to_array("probability")[1].alias(name))

    return p(model, "_a").join(p(found, "_b"), "transaction_id").select("transaction_id", (F.col("_a") == F.col("_b")).cast("int").alias("same"))


@reg("snk3_best_params_map", EV + """SELECT 'logistic' AS type, k AS param, v AS value FROM (
  VALUES ('balance', 'smote'), ('elasticNetParam', '0.0'), ('rows', CAST((SELECT count(*) FROM tx_events) AS VARCHAR))) t(k, v)""")
def snk3_best_params_map(spark, sf):
    """SNK3: a model's parameters as a map in the registry, one entry each."""
    model, _, rows = _fitted(spark, sf, LogisticRegression(elasticNetParam=0.0), "smote")
    registry = ModelRegistry(spark, scratch_path(spark, "params-registry"))
    registry.register_model(model, "best", "logistic", {"roc_auc": 0.5}, NUMERIC + OTHER,
                            {"balance": "smote", "elasticNetParam": 0.0, "rows": rows.count()})
    return registry.current().select("type", F.explode("params").alias("param", "value"))


# ---------------------------------------------------------------- distinct counts by sketches
_DISTINCT = ["card_number", "mcc", "merchant_category", "amount"]


def _distinct_sql(extra: str) -> str:
    return EV + " UNION ALL ".join(
        f"SELECT date_trunc('week', transaction_ts)::DATE::VARCHAR AS period, '{c}' AS column, count(DISTINCT {c}) AS n_distinct, {extra} FROM tx_events "
        f"WHERE {c} IS NOT NULL GROUP BY 1" for c in _DISTINCT)


@reg("agg_distinct_by_week", _distinct_sql("1 AS exact"))
def agg_distinct_by_week(spark, sf):
    """Distinct values per week from the days' kept values, exact below 100,000."""
    daily = DI.daily_distinct(tx_events(spark, sf), _DISTINCT, limit=100_000)
    out = DI.distinct_counts(daily, F.date_trunc("week", "day").cast("date"), limit=100_000)
    return out.withColumn("period", F.col("period").cast("string"))


@reg("agg_distinct_by_sketch", EV + " UNION ALL ".join(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n_distinct, 0 AS exact, 1 AS within_2_percent FROM tx_events" for c in _DISTINCT))
def agg_distinct_by_sketch(spark, sf):
    """Distinct values of the whole time from merged sketches alone, beside the exact count."""
    t = tx_events(spark, sf)
    daily = DI.daily_distinct(t, _DISTINCT, limit=0)
    out = DI.distinct_counts(daily, F.lit("all"), limit=0)
    exact = t.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.count_distinct(c).alias("n")) for c in _DISTINCT]).alias("a"))
    exact = exact.select(F.explode("a").alias("e")).select("e.column", "e.n")
    return out.join(exact, "column").select("column", F.col("n").alias("n_distinct"), "exact", (
        F.abs(F.col("n_distinct") - F.col("n")) <= F.greatest(0.02 * F.col("n"), F.lit(0.5))).cast("int").alias("within_2_percent"))


# ---------------------------------------------------------------- forms that no other query runs
_NATIONS = ["ALGERIA", "ARGENTINA", "BRAZIL", "CANADA", "CHINA", "EGYPT", "ETHIOPIA", "FRANCE", "GERMANY", "INDIA", "INDONESIA", "IRAN", "IRAQ",
            "JAPAN", "JORDAN", "KENYA", "MOROCCO", "MOZAMBIQUE", "PERU", "ROMANIA", "RUSSIA", "SAUDI ARABIA", "UNITED KINGDOM", "UNITED STATES", "VIETNAM"]


@reg("agg18_state_city_pivot", ORD + """, c AS (SELECT merchant_state, merchant_city, sum(fraud_indicator) / count(*) AS r FROM tx_orders GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT merchant_state, """ + ", ".join(f"""ROUND(coalesce(max(r) FILTER (merchant_city = '{n}'), 0), 6) AS "{n}" """ for n in _NATIONS) + " FROM c GROUP BY 1")
def agg18_state_city_pivot(spark, sf):
    """The rates as a table of states by cities; the cities are those of the table."""
    t = tx_orders(spark, sf)
    return rounded(ED.pair_rate_pivot(t, "merchant_state", "merchant_city", _NATIONS, 3))


@reg("agg25_kpis_with_latency", EV + """SELECT count(*) AS total_transactions, CAST(sum(fraud_indicator) AS BIGINT) AS fraud_count,
  ROUND(avg(fraud_indicator) * 100, 6) AS fraud_pct, ROUND(avg(amount), 6) AS avg_amount, ROUND(avg(minute(transaction_ts) + mcc), 6) AS avg_latency FROM tx_events""")
def agg25_kpis_with_latency(spark, sf):
    t = tx_events(spark, sf).withColumn("latency_ms", F.minute("transaction_ts") + F.col("mcc"))
    return rounded(ED.kpis(t, latency="latency_ms"))


@reg("agg29_alert_resolution", SC + """, a AS (SELECT CASE WHEN fraud_probability >= 0.9 THEN 'Critical' WHEN fraud_probability >= 0.8 THEN 'High'
      WHEN fraud_probability >= 0.7 THEN 'Medium' ELSE 'Low' END AS priority,
   CASE WHEN true_label = 1 THEN 'True Positive' ELSE 'False Positive' END AS disposition,
   epoch(date_trunc('hour', transaction_ts) + INTERVAL 2 HOUR) - floor(epoch(transaction_ts)) AS secs FROM scored WHERE fraud_probability >= 0.5),
c AS (SELECT priority, disposition, count(*) AS count, avg(secs / 60.0) AS m FROM a GROUP BY 1, 2)
SELECT priority, disposition, count, ROUND(m, 6) AS resolution_minutes, ROUND(count / sum(count) OVER (PARTITION BY priority), 6) AS share FROM c""")
def agg29_alert_resolution(spark, sf):
    """Alerts that are settled at the end of the next hour: minutes to settle them, beside the shares."""
    from risklib.streaming.alerts import alert_summary, alerts_from_scores
    a = alerts_from_scores(scored(spark, sf), 0.5)
    a = a.withColumn("timestamp", F.col("transaction_ts")).withColumn("resolved_at", F.date_trunc("hour", "transaction_ts") + F.expr("INTERVAL 2 HOURS"))
    return rounded(alert_summary(a))


@reg("src2_upload_csv", EV + """SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, CASE WHEN mcc % 10 = 0 THEN NULL ELSE amount END AS amount,
  CAST(coalesce(mcc % 10 = 0, false) AS INTEGER) AS corrupt FROM tx_events""")
def src2_upload_csv(spark, sf):
    """An upload in which every row of some categories has no number as its amount: those rows are kept, with their text."""
    from risklib.schema import TRANSACTIONS
    t = tx_events(spark, sf)
    bad = F.coalesce(F.col("mcc") % 10 == 0, F.lit(False))
    have = {"transaction_id": F.col("transaction_id").cast("string"), "card_number": F.col("card_number").cast("string"),
            "amount": F.when(bad, F.lit("n/a")).otherwise(F.col("amount").cast("string"))}
    path = scratch_path(spark, "upload")
    t.select(*[have.get(f.name, F.lit(None).cast("string")).alias(f.name) for f in TRANSACTIONS.fields]).write.option("header", True).csv(path)
    return read_upload_csv(spark, path).select("transaction_id", "amount", F.col("_corrupt_record").isNotNull().cast("int").alias("corrupt"))


@reg("cln5_timestamp_sources", EV + """SELECT transaction_id, 'stamp' AS source, strftime(transaction_ts, '%Y-%m-%d %H:%M:%S') AS ts FROM tx_events
UNION ALL SELECT transaction_id, 'date_and_time', CASE WHEN mcc % 7 <> 0 THEN strftime(transaction_ts, '%Y-%m-%d %H:%M:%S') END FROM tx_events
UNION ALL SELECT transaction_id, 'date', CASE WHEN mcc % 7 <> 0 THEN strftime(date_trunc('day', transaction_ts), '%Y-%m-%d %H:%M:%S') END FROM tx_events""")
def cln5_timestamp_sources(spark, sf):
    """The event time from each of its sources in turn: a stamp, date and time texts, a date text; bad texts give none."""
    t = tx_events(spark, sf).select("transaction_id", "mcc", F.col("transaction_ts").alias("_t"))
    day, clock = F.date_format("_t", "yyyy-MM-dd"), F.date_format("_t", "HH:mm:ss")
    good = F.col("mcc") % 7 != 0
    forms = {"stamp": t.withColumn("transaction_ts", F.col("_t")),
             "date_and_time": t.withColumns({"transaction_date": F.when(good, day).otherwise("soon"), "transaction_time": clock}),
             "date": t.withColumn("date", F.when(good, day).otherwise("soon"))}
    out = None
    for name, df in forms.items():
        one = FT.resolve_timestamp(df).select("transaction_id", F.lit(name).alias("source"), F.date_format("transaction_ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
        out = one if out is None else out.unionByName(one)
    return out
