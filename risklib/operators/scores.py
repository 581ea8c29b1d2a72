"""Rule scoring, decisions, reason codes and the risk-factor table (SCO5-SCO10, WIN9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklib.functions.exprs import flag
from risklib.schema import AMOUNT, CARD, ID, TS

# Fixed values of the rule scorecard.
BASE_PROBABILITY = 0.05
FACTOR_STEP = 0.15
MAX_PROBABILITY = 0.99
HIGH_AMOUNT = 1000
RISK_FACTOR_DESCRIPTIONS = [
    ("high_amount", "Transaction amount is unusually high"),
    ("unusual_time", "Transaction occurred during unusual hours"),
    ("international", "Transaction is international"),
    ("new_merchant", "First transaction with this merchant"),
    ("online_payment", "Online payment (higher risk channel)"),
]
RECOMMEND_BLOCK = "Block transaction and investigate"
RECOMMEND_APPROVE = "Approve transaction"
# Risk appetite -> recommended threshold range.
RISK_APPETITE = [("Conservative", 0.3, 0.4), ("Balanced", None, None), ("Permissive", 0.6, 0.8)]


def new_merchant_flag(df: DataFrame, merchant: str, out: str = "is_new_merchant") -> DataFrame:
    """WIN9: 1 on the card's first transaction at the merchant (order: time, id).

    A grouped min per (card, merchant) joined back instead of a row_number
    window, so a hot card or merchant is one aggregate row.
    """
    first = (df.groupBy(CARD, merchant)
               .agg(F.min(F.struct(F.col(TS).alias("t"), F.col(ID).alias("i"))).alias("_first")))
    out_df = df.join(first, [CARD, merchant], "left")
    is_first = (out_df["_first"]["t"].eqNullSafe(F.col(TS)) & (out_df["_first"]["i"] == F.col(ID)))
    return out_df.withColumn(out, flag(is_first)).drop("_first")


def rule_score(df: DataFrame, threshold: float = 0.5, international: Column | None = None,
               new_merchant: Column | None = None, online: Column | None = None,
               inclusive: bool = True) -> DataFrame:
    """SCO5/SCO7: .05 + .15 * (number of risk factors), capped at .99; decision at ``threshold``."""
    h = F.hour(TS)
    flags = {
        "high_amount": flag(F.col(AMOUNT) > HIGH_AMOUNT),
        "unusual_time": flag((h < 5) | (h > 22)),
        "international": flag(international) if international is not None else F.lit(0),
        "new_merchant": flag(new_merchant) if new_merchant is not None else F.lit(0),
        "online_payment": flag(online) if online is not None else F.lit(0),
    }
    for k, v in flags.items():
        df = df.withColumn(f"rf_{k}", v)
    total = None
    for k in flags:
        total = F.col(f"rf_{k}") if total is None else total + F.col(f"rf_{k}")
    p = F.least(F.lit(BASE_PROBABILITY) + F.lit(FACTOR_STEP) * total, F.lit(MAX_PROBABILITY))
    df = df.withColumn("fraud_probability", p)
    return decide(df, threshold, inclusive=inclusive)


def decide(df: DataFrame, threshold: float, prob: str = "fraud_probability", inclusive: bool = True) -> DataFrame:
    cond = (F.col(prob) >= threshold) if inclusive else (F.col(prob) > threshold)
    return (df.withColumn("is_fraud", flag(cond))
              .withColumn("recommendation", F.when(F.col("is_fraud") == 1, RECOMMEND_BLOCK).otherwise(RECOMMEND_APPROVE)))


def reason_codes(df: DataFrame, contributions: dict[str, Column], k: int = 3) -> DataFrame:
    """SCO6: signed contributions sorted by |w| (ties by name); top-k positive and negative names."""
    arr = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("w")) for n, c in contributions.items()])
    srt = F.array_sort(arr, lambda a, b: F.when(F.abs(a["w"]) > F.abs(b["w"]), -1)
                       .when(F.abs(a["w"]) < F.abs(b["w"]), 1)
                       .when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    pos = F.slice(F.filter(srt, lambda s: s["w"] > 0), 1, k)
    neg = F.slice(F.filter(srt, lambda s: s["w"] < 0), 1, k)
    return (df.withColumn("top_positive", F.array_join(F.transform(pos, lambda s: s["name"]), "|"))
              .withColumn("top_negative", F.array_join(F.transform(neg, lambda s: s["name"]), "|")))


def risk_factor_table(df: DataFrame, keys=(ID,)) -> DataFrame:
    """SCO10: one row per (transaction, factor) with description, High/Low level and score."""
    names = [n for n, _ in RISK_FACTOR_DESCRIPTIONS]
    stack = "stack({}, {}) as (factor, risk_score)".format(
        len(names), ", ".join(f"'{n}', CAST(rf_{n} AS DOUBLE)" for n in names))
    long = df.select(*keys, F.expr(stack))
    desc = F.create_map(*[x for n, d in RISK_FACTOR_DESCRIPTIONS for x in (F.lit(n), F.lit(d))])
    return long.select(*keys, "factor", desc[F.col("factor")].alias("description"),
                       F.when(F.col("risk_score") == 1.0, "High").otherwise("Low").alias("risk_level"),
                       "risk_score")


def risk_appetite_table(spark: SparkSession) -> DataFrame:
    """SCO9: fixed lookup (3 rows) of recommended threshold ranges."""
    return spark.createDataFrame(RISK_APPETITE, "appetite string, low double, high double")


def batch_summary(scored: DataFrame, prob: str = "fraud_probability", threshold: float = 0.5) -> DataFrame:
    """SCO8 totals: rows, flagged rows, flagged share, mean probability."""
    f = (F.col(prob) >= threshold).cast("int")
    return scored.agg(F.count(F.lit(1)).alias("total_transactions"), F.sum(f).cast("long").alias("flagged"),
                      F.try_divide(F.sum(f), F.count(F.lit(1))).alias("flagged_share"),
                      F.avg(prob).alias("mean_probability"))
