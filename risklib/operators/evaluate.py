"""Model evaluation on a scored DataFrame (EVA1-EVA17, EVA20, EVA21).

Input columns: ``true_label`` (0/1), ``fraud_probability`` in [0, 1], any
group columns. Every metric takes ``group_cols`` so that per-model and
per-segment evaluation is one grouped plan instead of a driver loop.

Curve statistics (AUC, average precision, ROC/PR points) need cumulative
sums over the score order. They are computed from the table of distinct
(group, score) rows with a two-level prefix sum: scores are cut into
``buckets`` ranges that follow the scores; bucket totals (bounded size) give the
offset of each bucket, and a window partitioned by (group, bucket) adds
the running sum inside the bucket. No window runs without a partition key
over row-level data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklib.functions.exprs import safe_div
from risklib.operators.keyed import attach_stats, written
from risklib.operators.quantiles import bin_of, fit_quantiles

Y, P = "true_label", "fraud_probability"
# Business costs.
COST_PER_FRAUD = 100
COST_PER_INVESTIGATION = 10
SWEEP_COST_FN, SWEEP_COST_FP = 1000, 50
DRIFT_TARGET, DRIFT_ALARM = 0.92, 0.88


def _z(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _counts(df: DataFrame, threshold: float, group_cols: Sequence[str], y: str, p: str) -> DataFrame:
    pred = (F.col(p) >= threshold).cast("long")
    yy = F.col(y).cast("long")
    return df.groupBy(*group_cols).agg(
        F.sum(pred * yy).alias("tp"), F.sum(pred * (1 - yy)).alias("fp"),
        F.sum((1 - pred) * (1 - yy)).alias("tn"), F.sum((1 - pred) * yy).alias("fn"))


def metrics_from_counts(df: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    tpr = _z(safe_div(tp, tp + fn))
    spec = _z(safe_div(tn, tn + fp))
    return (df.withColumn("accuracy", _z(safe_div(tp + tn, n)))
              .withColumn("precision", _z(safe_div(tp, tp + fp)))
              .withColumn("recall", tpr)
              .withColumn("f1", _z(safe_div(2 * tp, 2 * tp + fp + fn)))
              .withColumn("false_positive_rate", _z(safe_div(fp, fp + tn)))
              .withColumn("true_positive_rate", tpr)
              .withColumn("specificity", spec)
              .withColumn("balanced_accuracy", (tpr + spec) / 2))


# ---------------------------------------------------------------- EVA1/EVA2/EVA12
def classification_metrics(df: DataFrame, threshold: float = 0.5, group_cols: Sequence[str] = (),
                           y: str = Y, p: str = P, cost_fraud: float = COST_PER_FRAUD,
                           cost_investigation: float = COST_PER_INVESTIGATION) -> DataFrame:
    m = metrics_from_counts(_counts(df, threshold, group_cols, y, p))
    return (m.withColumn("fraud_cost", F.col("fn") * cost_fraud)
             .withColumn("investigation_cost", (F.col("tp") + F.col("fp")) * cost_investigation)
             .withColumn("total_cost", F.col("fraud_cost") + F.col("investigation_cost")))


# ---------------------------------------------------------------- score table + prefix sums
def score_ranges(df: DataFrame, p: str = P, buckets: int = 1024) -> list[float]:
    """Increasing range edges that follow the scores: a range between two of them holds about 1/buckets of the
    rows (one sketch pass; at most ``buckets`` numbers reach the driver)."""
    at = [i / buckets for i in range(1, buckets)]
    edges = df.agg(F.percentile_approx(F.col(p).cast("double"), at, 10 * buckets).alias("e")).first()["e"] or []
    return [-math.inf, *sorted({e for e in edges if math.isfinite(e)}), math.inf]


def score_table(df: DataFrame, group_cols: Sequence[str] = (), y: str = Y, p: str = P,
                buckets: int = 1024) -> DataFrame:
    """Distinct (group, score) with pos/neg counts and exclusive cumulative counts below the score."""
    g = list(group_cols)
    if not g:  # a constant group keeps every step a keyed join (no cross join)
        return score_table(df.withColumn("_g", F.lit(0)), ["_g"], y, p, buckets).drop("_g")
    return _ranked_scores(score_counts(df, g, y, p), g, buckets)


def score_counts(df: DataFrame, group_cols: Sequence[str], y: str = Y, p: str = P) -> DataFrame:
    """Distinct (group, score) with pos/neg counts, written once: the rows are read here and not again. Rows without a
    score are a null score."""
    return written(df.groupBy(*group_cols, F.col(p).alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg")), "scores")


def _ranked_scores(s: DataFrame, g: list[str], buckets: int = 1024) -> DataFrame:
    s = s.where("score IS NOT NULL")
    edges = score_ranges(s, "score", buckets)
    s = (Bucketizer(splits=edges, inputCol="score", outputCol="_bk", handleInvalid="keep").transform(s)
         if len(edges) > 2 else s.withColumn("_bk", F.lit(0.0)))
    bt = s.groupBy(*g, "_bk").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    wb = Window.partitionBy(*g).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    wg = Window.partitionBy(*g)  # bucket table: at most ``buckets`` rows per group
    bt = bt.select(*g, "_bk", F.coalesce(F.sum("_bp").over(wb), F.lit(0)).alias("_op"),
                   F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_on"),
                   F.sum("_bp").over(wg).alias("P"), F.sum("_bn").over(wg).alias("N"))
    wi = Window.partitionBy(*g, "_bk").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    s = attach_stats(s, bt, [*g, "_bk"], null_safe=True)  # a null group is one of its own
    return (s.withColumn("pos_below", F.col("_op") + F.coalesce(F.sum("pos").over(wi), F.lit(0)))
             .withColumn("neg_below", F.col("_on") + F.coalesce(F.sum("neg").over(wi), F.lit(0)))
             .drop("_bk", "_op", "_on"))


# ---------------------------------------------------------------- EVA3/EVA4/EVA5
def ranking_metrics(df: DataFrame, group_cols: Sequence[str] = (), y: str = Y, p: str = P) -> DataFrame:
    """roc_auc (Mann-Whitney with ties), average precision (step sum), Brier score per group."""
    g = list(group_cols)
    if not g:
        return ranking_metrics(df.withColumn("_g", F.lit(0)), ["_g"], y, p).drop("_g")
    return _ranking(score_table(df, g, y, p), g)


def _ranking(st: DataFrame, g: list[str]) -> DataFrame:
    tp = F.col("P") - F.col("pos_below")          # positives with score >= s
    fp = F.col("N") - F.col("neg_below")
    sc = F.col("score")
    agg = st.groupBy(*g, "P", "N").agg(
        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("_u"),
        F.sum(F.col("pos") * tp / (tp + fp)).alias("_ap"),
        # Brier from the same (score, pos, neg) table: positives add (1 - s)^2, negatives s^2
        F.sum(F.col("pos") * F.pow(1 - sc, 2) + F.col("neg") * F.pow(sc, 2)).alias("_b"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_u") / (F.col("P") * F.col("N")))
    ap = F.when(F.col("P") > 0, F.col("_ap") / F.col("P"))
    brier = F.col("_b") / (F.col("P") + F.col("N"))
    return agg.select(*g, auc.alias("roc_auc"), ap.alias("average_precision"), brier.alias("brier_score"))


# ---------------------------------------------------------------- EVA6/EVA7
def roc_points(df: DataFrame, group_cols: Sequence[str] = (), y: str = Y, p: str = P) -> DataFrame:
    st = score_table(df, group_cols, y, p)
    tp, fp = F.col("P") - F.col("pos_below"), F.col("N") - F.col("neg_below")
    return st.select(*group_cols, F.col("score").alias("threshold"),
                     _z(safe_div(fp, F.col("N"))).alias("fpr"), _z(safe_div(tp, F.col("P"))).alias("tpr"))


def pr_points(df: DataFrame, group_cols: Sequence[str] = (), y: str = Y, p: str = P) -> DataFrame:
    st = score_table(df, group_cols, y, p)
    tp, fp = F.col("P") - F.col("pos_below"), F.col("N") - F.col("neg_below")
    return st.select(*group_cols, F.col("score").alias("threshold"), safe_div(tp, tp + fp).alias("precision"),
                     _z(safe_div(tp, F.col("P"))).alias("recall"),
                     safe_div(F.col("P"), F.col("P") + F.col("N")).alias("baseline"))


# ---------------------------------------------------------------- EVA8
def calibration(df: DataFrame, n_bins: int = 10, group_cols: Sequence[str] = (), y: str = Y, p: str = P) -> DataFrame:
    """Right-closed uniform bins (edges compared as doubles, no rounding); empty bins absent."""
    k = F.ceil(F.col(p) * n_bins) - 1
    k = F.when(F.col(p) <= k / n_bins, k - 1).when(F.col(p) > (k + 1) / n_bins, k + 1).otherwise(k)
    b = F.greatest(k, F.lit(0)).cast("int")
    return (df.groupBy(*group_cols, b.alias("bin"))
              .agg(F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("fraction_positive"),
                   F.count(F.lit(1)).alias("count")))


# ---------------------------------------------------------------- EVA9
def threshold_sweep(df: DataFrame, group_cols: Sequence[str] = (), y: str = Y, p: str = P, steps: int = 100) -> DataFrame:
    """Metrics at thresholds k/steps, k = 1..steps-1, from one histogram + reverse cumulative sum."""
    g = list(group_cols)
    k = F.floor(F.col(p) * steps)  # the last threshold k / steps that the score reaches, compared as doubles
    k = F.when(F.col(p) < k / steps, k - 1).when(F.col(p) >= (k + 1) / steps, k + 1).otherwise(k)
    idx = F.least(F.greatest(k, F.lit(0)), F.lit(steps)).cast("int")
    yy = F.col(y).cast("long")
    h = df.groupBy(*g, idx.alias("k")).agg(F.sum(yy).alias("pos"), F.sum(1 - yy).alias("neg"))
    grid = (h.select(*g).distinct() if g else h.sparkSession.range(1).select())
    grid = grid.select(*g, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    full = attach_stats(grid, h, [*g, "k"], null_safe=True).na.fill(0, ["pos", "neg"])
    w = Window.partitionBy(*g).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    wt = Window.partitionBy(*g)
    c = (full.withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w))
             .withColumn("_P", F.sum("pos").over(wt)).withColumn("_N", F.sum("neg").over(wt)))
    c = c.where((F.col("k") >= 1) & (F.col("k") <= steps - 1))
    c = (c.withColumn("fn", F.col("_P") - F.col("tp")).withColumn("tn", F.col("_N") - F.col("fp"))
          .withColumn("threshold", F.round(F.col("k") / steps, 6)).drop("pos", "neg", "_P", "_N"))
    return metrics_from_counts(c).drop("true_positive_rate", "balanced_accuracy")


# ---------------------------------------------------------------- EVA10/EVA11
def optimal_thresholds(sweep: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """First (smallest) threshold maximising F1 / precision / recall, and minimising |P - R|."""
    g = list(group_cols)
    nt = -F.col("threshold")
    agg = sweep.groupBy(*g).agg(
        F.max_by("threshold", F.struct("f1", nt)).alias("f1"),
        F.max_by("threshold", F.struct("precision", nt)).alias("precision"),
        F.max_by("threshold", F.struct("recall", nt)).alias("recall"),
        F.min_by("threshold", F.struct(F.abs(F.col("precision") - F.col("recall")), "threshold")).alias("pr_balance"))
    return agg.select(*g, F.expr("stack(4, 'f1', f1, 'precision', precision, 'recall', recall, "
                                 "'pr_balance', pr_balance) as (criterion, threshold)"))


def cost_curve(sweep: DataFrame, cost_fn: float = SWEEP_COST_FN, cost_fp: float = SWEEP_COST_FP) -> DataFrame:
    return sweep.select("threshold", "fn", "fp", (F.col("fn") * cost_fn + F.col("fp") * cost_fp).alias("cost"))


def min_cost_threshold(sweep: DataFrame, group_cols: Sequence[str] = (), cost_fn: float = SWEEP_COST_FN,
                       cost_fp: float = SWEEP_COST_FP) -> DataFrame:
    c = sweep.withColumn("cost", F.col("fn") * cost_fn + F.col("fp") * cost_fp)
    return c.groupBy(*group_cols).agg(F.min_by("threshold", F.struct("cost", "threshold")).alias("threshold"),
                                      F.min("cost").alias("cost"))


# ---------------------------------------------------------------- EVA13/EVA14/EVA15
def normalized_confusion(df: DataFrame, threshold: float = 0.5, y: str = Y, p: str = P) -> DataFrame:
    pred = (F.col(p) >= threshold).cast("int")
    c = df.groupBy(F.col(y).alias("true_label"), pred.alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    of_label = Window.partitionBy("true_label")  # at most three rows; unlabelled rows are a line of their own
    return c.withColumn("share", F.col("count") / F.sum("count").over(of_label))


def metric_table(df: DataFrame, threshold: float = 0.5, y: str = Y, p: str = P) -> DataFrame:
    m = classification_metrics(df, threshold, (), y, p)
    m = (m.withColumn("false_negative_rate", _z(safe_div(F.col("fn"), F.col("fn") + F.col("tp"))))
          .withColumn("correct", (F.col("tp") + F.col("tn")).cast("double"))
          .withColumn("incorrect", (F.col("fp") + F.col("fn")).cast("double")))
    cols = ["accuracy", "precision", "recall", "f1", "specificity", "false_positive_rate", "false_negative_rate",
            "correct", "incorrect", "tp", "fp", "tn", "fn"]
    return m.select(F.expr("stack({}, {}) as (metric, value)".format(
        len(cols), ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in cols))))


def class_report(df: DataFrame, threshold: float = 0.5, y: str = Y, p: str = P) -> DataFrame:
    c = _counts(df, threshold, (), y, p)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    # class 1: tp/fp/fn; class 0 mirrors (tn as its tp)
    p1, r1 = _z(safe_div(tp, tp + fp)), _z(safe_div(tp, tp + fn))
    p0, r0 = _z(safe_div(tn, tn + fn)), _z(safe_div(tn, tn + fp))
    f1_1, f1_0 = _z(safe_div(2 * tp, 2 * tp + fp + fn)), _z(safe_div(2 * tn, 2 * tn + fn + fp))
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    rows = F.array(
        F.struct(F.lit("0").alias("cls"), p0.alias("precision"), r0.alias("recall"), f1_0.alias("f1"), s0.alias("support")),
        F.struct(F.lit("1").alias("cls"), p1.alias("precision"), r1.alias("recall"), f1_1.alias("f1"), s1.alias("support")),
        F.struct(F.lit("macro avg").alias("cls"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f1_0 + f1_1) / 2).alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("cls"), ((p0 * s0 + p1 * s1) / n).alias("precision"),
                 ((r0 * s0 + r1 * s1) / n).alias("recall"), ((f1_0 * s0 + f1_1 * s1) / n).alias("f1"),
                 n.alias("support")))
    return c.select(F.explode(rows).alias("r")).select(F.col("r.cls").alias("class"), "r.precision", "r.recall",
                                                        "r.f1", F.col("r.support").cast("long").alias("support"))


# ---------------------------------------------------------------- EVA16/EVA17
def compare_models(scored_long: DataFrame, model_col: str = "model", threshold: float = 0.5) -> DataFrame:
    """Threshold and ranking metrics per model, all from the table of distinct scores: one pass over the rows."""
    s = score_counts(scored_long, [model_col])
    hit = F.col("score") >= threshold
    counts = s.groupBy(model_col).agg(*[F.sum(F.when(c, F.col(n)).otherwise(0)).alias(name) for name, c, n in (
        ("tp", hit, "pos"), ("fp", hit, "neg"), ("tn", ~hit, "neg"), ("fn", ~hit, "pos"))])
    m = metrics_from_counts(counts).select(model_col, "accuracy", "precision", "recall", "f1")
    r = _ranking(_ranked_scores(s, [model_col]), [model_col])
    return attach_stats(m, r, [model_col], null_safe=True).orderBy(F.desc("roc_auc"), model_col)


def segment_metrics(df: DataFrame, segment: str, threshold: float = 0.5, y: str = Y, p: str = P) -> DataFrame:
    """Rows, fraud rate, threshold metrics and AUC per segment; rows without a segment are a segment of their own."""
    pred, yy = (F.col(p) >= threshold).cast("long"), F.col(y).cast("long")
    one = df.groupBy(segment).agg(  # counts and rates from the same pass
        F.count(F.lit(1)).alias("count"), F.avg(F.col(y).cast("double")).alias("fraud_rate"),
        F.sum(pred * yy).alias("tp"), F.sum(pred * (1 - yy)).alias("fp"),
        F.sum((1 - pred) * (1 - yy)).alias("tn"), F.sum((1 - pred) * yy).alias("fn"))
    m = metrics_from_counts(one).select(segment, "count", "fraud_rate", "accuracy", "precision", "recall", "f1")
    r = ranking_metrics(df, [segment], y, p).select(segment, "roc_auc")
    return attach_stats(m, r, [segment], null_safe=True).orderBy(F.desc("count"), segment)


# ---------------------------------------------------------------- EVA20
def daily_drift(df: DataFrame, ts: str = "transaction_ts", threshold: float = 0.5, y: str = Y, p: str = P) -> DataFrame:
    d = df.withColumn("day", F.to_date(ts))
    m = classification_metrics(d, threshold, ["day"], y, p).select("day", "accuracy", "precision", "recall")
    w7 = Window.orderBy(F.unix_date("day")).rangeBetween(-6, 0)    # small daily table
    min_recall = m.select(F.min("recall")).scalar()
    return (m.withColumn("recall_7d", F.avg("recall").over(w7))
             .withColumn("below_target", (F.col("accuracy") < DRIFT_TARGET).cast("int"))
             .withColumn("recall_alarm", (min_recall < DRIFT_ALARM).cast("int")))


# ---------------------------------------------------------------- EVA21
def psi(df: DataFrame, features: Sequence[str], split, bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability per feature: decile edges from the reference period (before ``split``),
    right-closed bins, PSI = sum (cur - ref) * ln(cur / ref) with shares floored at eps."""
    qs = [i / bins for i in range(1, bins)]
    edges = fit_quantiles(df.where(~split), features, qs)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), bin_of(F.col(f).cast("double"), edges[f]).alias("bin"))
                                for f in features]))
    g = (df.select(split.alias("_cur"), cells.alias("_c")).select("_cur", "_c.*").where("bin IS NOT NULL")
           .groupBy("feature", "bin").agg(F.sum(F.when(~F.col("_cur"), 1).otherwise(0)).alias("_r"),
                                          F.sum(F.when(F.col("_cur"), 1).otherwise(0)).alias("_c")))
    wf = Window.partitionBy("feature")  # at most ``bins`` rows of a feature
    ref = F.greatest(F.col("_r") / F.sum("_r").over(wf), F.lit(eps))
    cur = F.greatest(F.col("_c") / F.sum("_c").over(wf), F.lit(eps))
    terms = g.select("feature", ((cur - ref) * F.log(cur / ref)).alias("t"))
    one = terms.agg(*[F.sum(F.when(F.col("feature") == f, F.col("t"))).alias(f"p{i}") for i, f in enumerate(features)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"p{i}").alias("psi"))
                                          for i, f in enumerate(features)])).alias("x")).select("x.*")
