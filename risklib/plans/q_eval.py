"""Evaluation queries on the deterministic ``scored`` table (EVA1-EVA17, EVA20, EVA21, TOP3, TOP4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklib.functions.exprs import weekday
from risklib.operators import evaluate as EV_
from risklib.plans.common import rounded
from risklib.plans.sqlviews import SC, SCM
from risklib.sources.tables import scored, scored_models

Q, SQL = {}, {}


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _counts_sql(t: float, src: str = "scored", group: str = "") -> str:
    sel = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return f"""SELECT {sel}CAST(sum(CASE WHEN fraud_probability >= {t} AND true_label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN fraud_probability >= {t} AND true_label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN fraud_probability < {t} AND true_label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN fraud_probability < {t} AND true_label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM {src}{gb}"""


_M = """coalesce(CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) END, 0.0) AS accuracy,
  coalesce(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 0.0) AS precision,
  coalesce(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 0.0) AS recall,
  coalesce(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 0.0) AS f1,
  coalesce(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 0.0) AS false_positive_rate,
  coalesce(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END, 0.0) AS specificity"""


# ---------------------------------------------------------------- EVA1/EVA2
@reg("eva1_classification_metrics", SC + ", c AS (" + _counts_sql(0.5) + "), m AS (SELECT tp, fp, tn, fn, " + _M + """,
  coalesce(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 0.0) AS true_positive_rate,
  (coalesce(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 0.0) + coalesce(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END, 0.0)) / 2
    AS balanced_accuracy FROM c)
SELECT tp, fp, tn, fn, ROUND(accuracy, 6) AS accuracy, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,
  ROUND(f1, 6) AS f1, ROUND(false_positive_rate, 6) AS false_positive_rate, ROUND(specificity, 6) AS specificity,
  ROUND(true_positive_rate, 6) AS true_positive_rate, ROUND(balanced_accuracy, 6) AS balanced_accuracy,
  CAST(fn * 100 AS BIGINT) AS fraud_cost, CAST((tp + fp) * 10 AS BIGINT) AS investigation_cost,
  CAST(fn * 100 + (tp + fp) * 10 AS BIGINT) AS total_cost
FROM m""")
def eva1_classification_metrics(spark, sf):
    return rounded(EV_.classification_metrics(scored(spark, sf), 0.5))


# ---------------------------------------------------------------- EVA12
@reg("eva12_investigation_cost", SC + ", c AS (" + _counts_sql(0.3) + """)
SELECT tp, fp, fn, CAST(fn * 250 AS BIGINT) AS fraud_cost, CAST((tp + fp) * 25 AS BIGINT) AS investigation_cost,
  CAST(fn * 250 + (tp + fp) * 25 AS BIGINT) AS total_cost FROM c""")
def eva12_investigation_cost(spark, sf):
    m = EV_.classification_metrics(scored(spark, sf), 0.3, cost_fraud=250, cost_investigation=25)
    return m.select("tp", "fp", "fn", "fraud_cost", "investigation_cost", "total_cost")


# ---------------------------------------------------------------- EVA3/EVA4/EVA5
def _cum_sql(src: str = "scored", group: str = "") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    return f"""st AS (SELECT {g}fraud_probability AS score, sum(true_label) AS pos, sum(1 - true_label) AS neg
   FROM {src} WHERE fraud_probability IS NOT NULL GROUP BY {g}fraud_probability),
cum AS (SELECT {g}score, pos, neg,
   coalesce(sum(pos) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below,
   coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
   sum(pos) OVER ({part.strip()}) AS P, sum(neg) OVER ({part.strip()}) AS N FROM st)"""


def _rank_sql(group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return f"""SELECT {g}ROUND(CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (neg_below + 0.5 * neg)) / (max(P) * max(N)) END, 6) AS roc_auc,
  ROUND(CASE WHEN max(P) > 0 THEN sum(pos * (P - pos_below) / ((P - pos_below) + (N - neg_below))) / max(P) END, 6) AS average_precision
FROM cum{gb}"""


@reg("eva3_ranking_metrics", SC + ", " + _cum_sql() + """, r AS (""" + _rank_sql() + """)
SELECT roc_auc, average_precision, (SELECT ROUND(avg(pow(fraud_probability - true_label, 2)), 6) FROM scored) AS brier_score FROM r""")
def eva3_ranking_metrics(spark, sf):
    return rounded(EV_.ranking_metrics(scored(spark, sf)))


# ---------------------------------------------------------------- EVA6/EVA7
@reg("eva6_roc_points", SC + ", " + _cum_sql() + """
SELECT score AS threshold, ROUND(coalesce((N - neg_below) / N, 0.0), 6) AS fpr, ROUND(coalesce((P - pos_below) / P, 0.0), 6) AS tpr FROM cum""")
def eva6_roc_points(spark, sf):
    return rounded(EV_.roc_points(scored(spark, sf)))


@reg("eva7_pr_points", SC + ", " + _cum_sql() + """
SELECT score AS threshold, ROUND((P - pos_below) / ((P - pos_below) + (N - neg_below)), 6) AS precision,
  ROUND(coalesce((P - pos_below) / P, 0.0), 6) AS recall, ROUND(P / (P + N), 6) AS baseline FROM cum""")
def eva7_pr_points(spark, sf):
    return rounded(EV_.pr_points(scored(spark, sf)))


# ---------------------------------------------------------------- EVA8
@reg("eva8_calibration", SC + """SELECT CAST(greatest(ceil(round(fraud_probability * 10, 6)) - 1, 0) AS INTEGER) AS bin,
  ROUND(avg(fraud_probability), 6) AS mean_predicted, ROUND(avg(CAST(true_label AS DOUBLE)), 6) AS fraction_positive,
  count(*) AS count FROM scored GROUP BY 1""")
def eva8_calibration(spark, sf):
    return rounded(EV_.calibration(scored(spark, sf), 10))


# ---------------------------------------------------------------- EVA9/EVA10/EVA11
_SWEEP = """h AS (SELECT CAST(least(greatest(floor(round(fraud_probability * 100, 6)), 0), 100) AS INTEGER) AS k,
   sum(true_label) AS pos, sum(1 - true_label) AS neg FROM scored GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS k FROM range(0, 101)),
f AS (SELECT g.k, coalesce(h.pos, 0) AS pos, coalesce(h.neg, 0) AS neg FROM g LEFT JOIN h ON g.k = h.k),
cc AS (SELECT k, sum(pos) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS tp,
   sum(neg) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM f),
c AS (SELECT ROUND(k / 100, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
   CAST(N - fp AS BIGINT) AS tn, CAST(P - tp AS BIGINT) AS fn FROM cc WHERE k BETWEEN 1 AND 99),
sw AS (SELECT threshold, tp, fp, tn, fn, """ + _M + """ FROM c)"""


@reg("eva9_threshold_sweep", SC + ", " + _SWEEP + """
SELECT threshold, tp, fp, tn, fn, ROUND(accuracy, 6) AS accuracy, ROUND(precision, 6) AS precision,
  ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, ROUND(false_positive_rate, 6) AS false_positive_rate,
  ROUND(specificity, 6) AS specificity FROM sw""")
def eva9_threshold_sweep(spark, sf):
    return rounded(EV_.threshold_sweep(scored(spark, sf)).drop("k"))


@reg("eva10_optimal_thresholds", SC + ", " + _SWEEP + """
(SELECT 'f1' AS criterion, threshold FROM sw ORDER BY f1 DESC, threshold LIMIT 1)
UNION ALL (SELECT 'precision', threshold FROM sw ORDER BY precision DESC, threshold LIMIT 1)
UNION ALL (SELECT 'recall', threshold FROM sw ORDER BY recall DESC, threshold LIMIT 1)
UNION ALL (SELECT 'pr_balance', threshold FROM sw ORDER BY abs(precision - recall), threshold LIMIT 1)""")
def eva10_optimal_thresholds(spark, sf):
    return EV_.optimal_thresholds(EV_.threshold_sweep(scored(spark, sf)))


@reg("eva11_cost_curve", SC + ", " + _SWEEP + """
SELECT threshold, fn, fp, CAST(fn * 1000 + fp * 50 AS BIGINT) AS cost FROM sw""")
def eva11_cost_curve(spark, sf):
    return EV_.cost_curve(EV_.threshold_sweep(scored(spark, sf)))


@reg("eva11_min_cost_threshold", SC + ", " + _SWEEP + """
SELECT threshold, CAST(fn * 1000 + fp * 50 AS BIGINT) AS cost FROM sw ORDER BY fn * 1000 + fp * 50, threshold LIMIT 1""")
def eva11_min_cost_threshold(spark, sf):
    return EV_.min_cost_threshold(EV_.threshold_sweep(scored(spark, sf)))


# ---------------------------------------------------------------- EVA13/EVA14/EVA15
@reg("eva13_normalized_confusion", SC + """, c AS (SELECT true_label, CAST(fraud_probability >= 0.5 AS INTEGER) AS predicted,
  count(*) AS count FROM scored GROUP BY 1, 2)
SELECT true_label, predicted, count, ROUND(count / sum(count) OVER (PARTITION BY true_label), 6) AS share FROM c""")
def eva13_normalized_confusion(spark, sf):
    return rounded(EV_.normalized_confusion(scored(spark, sf)))


@reg("eva14_metric_table", SC + ", c AS (" + _counts_sql(0.5) + "), m AS (SELECT *, " + _M + """,
  coalesce(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) END, 0.0) AS fnr FROM c)
SELECT metric, ROUND(value, 6) AS value FROM (
  SELECT 'accuracy' AS metric, accuracy AS value FROM m UNION ALL SELECT 'precision', precision FROM m
  UNION ALL SELECT 'recall', recall FROM m UNION ALL SELECT 'f1', f1 FROM m
  UNION ALL SELECT 'specificity', specificity FROM m UNION ALL SELECT 'false_positive_rate', false_positive_rate FROM m
  UNION ALL SELECT 'false_negative_rate', fnr FROM m UNION ALL SELECT 'correct', CAST(tp + tn AS DOUBLE) FROM m
  UNION ALL SELECT 'incorrect', CAST(fp + fn AS DOUBLE) FROM m UNION ALL SELECT 'tp', CAST(tp AS DOUBLE) FROM m
  UNION ALL SELECT 'fp', CAST(fp AS DOUBLE) FROM m UNION ALL SELECT 'tn', CAST(tn AS DOUBLE) FROM m
  UNION ALL SELECT 'fn', CAST(fn AS DOUBLE) FROM m)""")
def eva14_metric_table(spark, sf):
    return rounded(EV_.metric_table(scored(spark, sf)))


@reg("eva15_class_report", SC + ", c AS (" + _counts_sql(0.5) + """),
k AS (SELECT coalesce(CASE WHEN tn + fn > 0 THEN tn / (tn + fn) END, 0.0) AS p0, coalesce(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END, 0.0) AS r0,
   coalesce(CASE WHEN 2 * tn + fn + fp > 0 THEN 2 * tn / (2 * tn + fn + fp) END, 0.0) AS f0, tn + fp AS s0,
   coalesce(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 0.0) AS p1, coalesce(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 0.0) AS r1,
   coalesce(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 0.0) AS f1_, tp + fn AS s1 FROM c)
SELECT class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
  SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM k
  UNION ALL SELECT '1', p1, r1, f1_, s1 FROM k
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1_) / 2, s0 + s1 FROM k
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1_ * s1) / (s0 + s1), s0 + s1 FROM k)""")
def eva15_class_report(spark, sf):
    return rounded(EV_.class_report(scored(spark, sf)))


# ---------------------------------------------------------------- EVA16/TOP4
_CMP_SQL = SCM + ", c AS (" + _counts_sql(0.5, "scored_models", "model") + "), m AS (SELECT model, " + _M + " FROM c), " \
    + _cum_sql("scored_models", "model") + ", r AS (" + _rank_sql("model") + """),
b AS (SELECT model, ROUND(avg(pow(fraud_probability - true_label, 2)), 6) AS brier_score FROM scored_models GROUP BY model),
cmp AS (SELECT m.model, ROUND(accuracy, 6) AS accuracy, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall,
   ROUND(f1, 6) AS f1, r.roc_auc, r.average_precision, b.brier_score
 FROM m JOIN r ON m.model = r.model JOIN b ON m.model = b.model)
"""


@reg("eva16_compare_models", _CMP_SQL + "SELECT * FROM cmp")
def eva16_compare_models(spark, sf):
    return rounded(EV_.compare_models(scored_models(spark, sf)))


@reg("top4_best_model", _CMP_SQL + "SELECT model AS best_model, roc_auc FROM cmp ORDER BY coalesce(roc_auc, 0) DESC, model LIMIT 1")
def top4_best_model(spark, sf):
    c = EV_.compare_models(scored_models(spark, sf))
    best = F.struct(-F.coalesce("roc_auc", F.lit(0.0)), "model")  # ties go to the first name
    return rounded(c.agg(F.min_by("model", best).alias("best_model"), F.min_by("roc_auc", best).alias("roc_auc")))


# ---------------------------------------------------------------- EVA17
_SEG = """seg AS (SELECT *, CAST(isodow(transaction_ts) - 1 AS INTEGER) AS segment FROM scored)"""


@reg("eva17_segment_metrics", SC + ", " + _SEG + ", c AS (" + _counts_sql(0.5, "seg", "segment") + "), m AS (SELECT segment, " + _M
     + " FROM c), " + _cum_sql("seg", "segment") + ", r AS (" + _rank_sql("segment") + """),
base AS (SELECT segment, count(*) AS count, avg(CAST(true_label AS DOUBLE)) AS fraud_rate FROM seg GROUP BY 1)
SELECT base.segment, base.count, ROUND(base.fraud_rate, 6) AS fraud_rate, ROUND(accuracy, 6) AS accuracy,
  ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, r.roc_auc
FROM base JOIN m ON base.segment = m.segment LEFT JOIN r ON base.segment = r.segment""")
def eva17_segment_metrics(spark, sf):
    s = scored(spark, sf).withColumn("segment", weekday("transaction_ts"))
    return rounded(EV_.segment_metrics(s, "segment"))


@reg("eva17_nullable_segments", SQL["eva17_segment_metrics"].replace("SELECT base.segment,", "SELECT NULLIF(base.segment, 3) AS segment,"))
def eva17_nullable_segments(spark, sf):
    """Rows of one weekday without a segment: they are a segment of their own."""
    s = scored(spark, sf).withColumn("segment", F.nullif(weekday("transaction_ts"), F.lit(3)))
    return rounded(EV_.segment_metrics(s, "segment"))


@reg("eva17_single_class_segments", SC + ", c AS (" + _counts_sql(0.5, "scored", "merchant_category") + "), m AS (SELECT merchant_category, " + _M
     + " FROM c), " + _cum_sql("scored", "merchant_category") + ", r AS (" + _rank_sql("merchant_category") + """),
base AS (SELECT merchant_category, count(*) AS count, avg(CAST(true_label AS DOUBLE)) AS fraud_rate FROM scored GROUP BY 1)
SELECT base.merchant_category, base.count, ROUND(base.fraud_rate, 6) AS fraud_rate, ROUND(accuracy, 6) AS accuracy,
  ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, r.roc_auc
FROM base JOIN m ON base.merchant_category = m.merchant_category LEFT JOIN r ON base.merchant_category = r.merchant_category""")
def eva17_single_class_segments(spark, sf):
    return rounded(EV_.segment_metrics(scored(spark, sf), "merchant_category"))


# ---------------------------------------------------------------- EVA20
@reg("eva20_daily_drift", SC + """, d AS (SELECT *, CAST(transaction_ts AS DATE) AS day FROM scored),
c AS (""" + _counts_sql(0.5, "d", "day") + """),
m AS (SELECT day, """ + _M + """ FROM c),
w AS (SELECT day, accuracy, precision, recall,
   avg(recall) OVER (ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS recall_7d FROM m)
SELECT strftime(day, '%Y-%m-%d') AS day, ROUND(accuracy, 6) AS accuracy, ROUND(precision, 6) AS precision,
  ROUND(recall, 6) AS recall, ROUND(recall_7d, 6) AS recall_7d, CAST(accuracy < 0.92 AS INTEGER) AS below_target,
  CAST((SELECT min(recall) FROM m) < 0.88 AS INTEGER) AS recall_alarm FROM w""")
def eva20_daily_drift(spark, sf):
    d = EV_.daily_drift(scored(spark, sf))
    return rounded(d.withColumn("day", F.date_format("day", "yyyy-MM-dd")))


# ---------------------------------------------------------------- EVA21
def _psi_sql(col: str) -> str:
    return f"""SELECT '{col}' AS feature, ROUND(sum((greatest(c / CC, 0.0001) - greatest(r / RR, 0.0001))
      * ln(greatest(c / CC, 0.0001) / greatest(r / RR, 0.0001))), 6) AS psi FROM (
  SELECT b, r, c, sum(r) OVER () AS RR, sum(c) OVER () AS CC FROM (
    SELECT b, sum(CASE WHEN NOT cur THEN 1 ELSE 0 END) AS r, sum(CASE WHEN cur THEN 1 ELSE 0 END) AS c FROM (
      SELECT cur, len(list_filter(e, lambda t: x.v > t)) AS b FROM (
        SELECT CAST({col} AS DOUBLE) AS v, transaction_ts >= TIMESTAMP '2024-01-16' AS cur FROM scored WHERE {col} IS NOT NULL) x,
        (SELECT quantile_cont(CAST({col} AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e
           FROM scored WHERE transaction_ts < TIMESTAMP '2024-01-16') q) GROUP BY b))"""


@reg("eva21_feature_psi", SC + _psi_sql("transaction_amount") + " UNION ALL " + _psi_sql("fraud_probability"))
def eva21_feature_psi(spark, sf):
    s = scored(spark, sf)
    split = F.col("transaction_ts") >= F.lit("2024-01-16").cast("timestamp")
    return rounded(EV_.psi(s, ["transaction_amount", "fraud_probability"], split))


# ---------------------------------------------------------------- TOP3
@reg("top3_errors", SC + """(SELECT 'false_positive' AS kind, transaction_id, fraud_probability FROM scored
  WHERE true_label = 0 AND fraud_probability >= 0.5 ORDER BY fraud_probability DESC, transaction_id LIMIT 5)
UNION ALL (SELECT 'false_negative', transaction_id, fraud_probability FROM scored
  WHERE true_label = 1 AND fraud_probability < 0.5 ORDER BY fraud_probability DESC, transaction_id LIMIT 5)""")
def top3_errors(spark, sf):
    s = scored(spark, sf)
    fp = (s.where((F.col("true_label") == 0) & (F.col("fraud_probability") >= 0.5))
           .orderBy(F.desc("fraud_probability"), "transaction_id").limit(5)
           .select(F.lit("false_positive").alias("kind"), "transaction_id", "fraud_probability"))
    fn = (s.where((F.col("true_label") == 1) & (F.col("fraud_probability") < 0.5))
           .orderBy(F.desc("fraud_probability"), "transaction_id").limit(5)
           .select(F.lit("false_negative").alias("kind"), "transaction_id", "fraud_probability"))
    return fp.unionByName(fn)
