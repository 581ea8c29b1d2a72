"""Alerts derived from scores (batch or per micro-batch) and their summary (AGG29, SCL15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Priority bands of the risk score.
PRIORITY_BANDS = [(0.9, "Critical"), (0.8, "High"), (0.7, "Medium")]
LOWEST_PRIORITY = "Low"


def alerts_from_scores(scored: DataFrame, threshold: float = 0.5, prob: str = "fraud_probability",
                       label: str | None = "true_label") -> DataFrame:
    p = F.col(prob)
    pr = None
    for lo, name in PRIORITY_BANDS:
        pr = F.when(p >= lo, name) if pr is None else pr.when(p >= lo, name)
    a = scored.where(p >= threshold).withColumn("priority", pr.otherwise(LOWEST_PRIORITY))
    if label and label in scored.columns:
        a = a.withColumn("disposition", F.when(F.col(label) == 1, "True Positive").otherwise("False Positive"))
    return a


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Disposition counts and shares within each priority; mean resolution minutes when resolved_at exists."""
    keys = ["priority", "disposition"]
    aggs = [F.count(F.lit(1)).alias("count")]
    if "resolved_at" in alerts.columns and "timestamp" in alerts.columns:
        aggs.append(F.avg((F.unix_seconds("resolved_at") - F.unix_seconds("timestamp")) / 60.0).alias("resolution_minutes"))
    c = alerts.groupBy(*keys).agg(*aggs)
    tot = c.groupBy("priority").agg(F.sum("count").alias("_t"))
    return c.join(tot, "priority").withColumn("share", F.col("count") / F.col("_t")).drop("_t")
