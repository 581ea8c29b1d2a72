"""Nearest neighbours and the balancing methods built on them (BAL1, BAL2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklib.operators import neighbours as N
from risklib.operators.keyed import written
from risklib.plans.common import rounded
from risklib.plans.sqlviews import EV
from risklib.sources.tables import tx_events

Q, SQL = {}, {}
COORDS = ["amount", "mcc", "hour"]


def reg(name, sql=None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def _rows(spark, sf):
    t = tx_events(spark, sf)
    return t.select("transaction_id", "fraud_indicator", "amount", "mcc", F.hour("transaction_ts").alias("hour"))


_T = EV + """, t AS (SELECT transaction_id, fraud_indicator, amount, mcc, CAST(hour(transaction_ts) AS INTEGER) AS hour FROM tx_events),
cls AS (SELECT CASE WHEN p <= n THEN 1 ELSE 0 END AS minority, greatest(p, n) - least(p, n) AS missing
  FROM (SELECT count(*) FILTER (fraud_indicator = 1) AS p, count(*) FILTER (fraud_indicator = 0) AS n FROM t))
"""


# ---------------------------------------------------------------- nearest neighbours
@reg("bal1_embedding_neighbours", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT a.vec_id, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v)) AS rank
  FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, ROUND(distance, 6) AS distance FROM d WHERE rank <= 5""")
def bal1_embedding_neighbours(spark, sf):
    """The 5 nearest vectors of every embedding: exact."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = e.select(F.col("vec_id").alias("r"), F.col("embedding").cast("array<double>").alias("v"), F.lit(True).alias("ask"))
    return rounded(N.nearest_neighbours(rows).select(F.col("r").alias("vec_id"), "rank", "distance"))


# ---------------------------------------------------------------- BAL1
@reg("bal1_smote", _T + """, b AS (SELECT t.transaction_id, row_number() OVER (ORDER BY md5(CAST(transaction_id AS VARCHAR) || '42'), transaction_id) - 1 AS rk,
   count(*) OVER () AS m, missing FROM t, cls WHERE fraud_indicator = minority AND amount IS NOT NULL AND mcc IS NOT NULL AND hour IS NOT NULL),
s AS (SELECT transaction_id, unnest(generate_series(1, missing // m + CAST(rk < missing % m AS INTEGER))) AS copy FROM b)
SELECT transaction_id, fraud_indicator, 0 AS copy, CAST(NULL AS DOUBLE) AS gap, 1 AS on_segment FROM t
UNION ALL SELECT transaction_id, minority, CAST(copy AS INTEGER),
  ROUND(CAST('0x' || substr(md5(concat_ws('|', transaction_id, copy, 'gap42')), 1, 13) AS BIGINT) / 4503599627370496.0, 6), 1 FROM s, cls""")
def bal1_smote(spark, sf):
    """All rows and the new ones; ``on_segment`` says that a new row lies between its two minority rows at ``gap``."""
    t = _rows(spark, sf)
    return _checked(t, written(N.smote(t, COORDS, "transaction_id"), "smote-out"))


def _checked(t, out):
    ends = t.select(F.col("transaction_id").alias("_k"), F.col("fraud_indicator").alias("_y"), *[F.col(c).cast("double").alias(f"_{c}") for c in COORDS])
    based = out.join(ends.select([F.col(c).alias(f"{c}_a") for c in ends.columns]), F.col("transaction_id") == F.col("_k_a"))
    # only new rows have a neighbour: the others would meet as nulls in one task of the join
    made = based.where("copy > 0").join(ends.select([F.col(c).alias(f"{c}_b") for c in ends.columns]), F.col("neighbour") == F.col("_k_b"), "left")
    between = (F.col("_k_a") != F.col("_k_b")) & (F.col("_y_a") == F.col("_y_b")) & (F.col("_y_a") == F.col("fraud_indicator"))
    for c in COORDS:
        a, b = F.col(f"_{c}_a"), F.col(f"_{c}_b")
        between = between & (F.abs(F.col(c) - (a + F.col("gap") * (b - a))) < 1e-9)
    columns = ["transaction_id", "fraud_indicator", "copy", "gap"]
    return rounded(based.where("copy = 0").select(*columns, F.lit(1).alias("on_segment")).unionByName(
        made.select(*columns, F.coalesce(between.cast("int"), F.lit(0)).alias("on_segment"))))


@reg("prp1_smote_training_rows", EV + """, c AS (SELECT fraud_indicator, count(*) - round(count(*) * 0.2) AS n FROM tx_events GROUP BY 1)
SELECT CAST(fraud_indicator AS DOUBLE) AS label, CAST(max(n) OVER () AS BIGINT) AS train_rows FROM c""")
def prp1_smote_training_rows(spark, sf):
    """The default preparation: split, imputation and scaling fitted on the training rows, which SMOTE then balances."""
    from risklib.ml.pipeline import prepare_data
    train, _ = prepare_data(_rows(spark, sf), "transaction_id", COORDS, balance="smote")
    return train.groupBy("label").agg(F.count(F.lit(1)).alias("train_rows"))


# ---------------------------------------------------------------- BAL2
@reg("bal2_adasyn", _T + """SELECT t.fraud_indicator, count(*) + any_value(CASE WHEN t.fraud_indicator = minority THEN missing ELSE 0 END) AS n_rows,
  any_value(CASE WHEN t.fraud_indicator = minority THEN missing ELSE 0 END) AS new_rows, 0 AS off_segment, 1 AS copies_gapless FROM t, cls GROUP BY 1""")
def bal2_adasyn(spark, sf):
    """Rows per class after ADASYN; no new row off its segment, and the copies of a base row numbered from 1."""
    t = _rows(spark, sf)
    out = _checked(t, written(N.adasyn(t, COORDS, "transaction_id"), "adasyn-out"))
    per = out.groupBy("fraud_indicator", "transaction_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("copy").alias("top"), F.count_if(F.col("copy") > 0).alias("new"), F.count_if(F.col("on_segment") == 0).alias("off"))
    return per.groupBy("fraud_indicator").agg(F.sum("n").alias("n_rows"), F.sum("new").alias("new_rows"), F.sum("off").alias("off_segment"),
                                              F.min((F.col("top") + 1 == F.col("n")).cast("int")).alias("copies_gapless"))


@reg("bal2_adasyn_counts", _T + """, near AS (SELECT a.transaction_id, b.fraud_indicator AS y,
    row_number() OVER (PARTITION BY a.transaction_id ORDER BY abs(a.amount - b.amount), b.transaction_id) AS rank
  FROM (SELECT t.* FROM t, cls WHERE fraud_indicator = minority AND amount IS NOT NULL) a JOIN t b ON a.transaction_id <> b.transaction_id AND b.amount IS NOT NULL),
w AS (SELECT transaction_id, CAST(sum(CAST(y <> minority AS INTEGER)) AS BIGINT) AS majority FROM near, cls WHERE rank <= 5 GROUP BY 1),
f AS (SELECT w.*, missing * majority // sum(majority) OVER () AS base, missing * majority % sum(majority) OVER () AS rest, missing FROM w, cls),
o AS (SELECT *, missing - sum(base) OVER () AS spare, row_number() OVER (
  ORDER BY rest DESC, majority DESC, md5(CAST(transaction_id AS VARCHAR) || '42'), transaction_id) AS rk FROM f)
SELECT transaction_id, majority, CAST(base + CAST(rk <= spare AND rest > 0 AS INTEGER) AS BIGINT) AS new_rows FROM o""")
def bal2_adasyn_counts(spark, sf):
    """ADASYN's own numbers along one coordinate, where the neighbours are exact: majority neighbours and new rows of every minority row."""
    t = _rows(spark, sf).where("amount IS NOT NULL")
    minority, n_min, n_maj = N._classes(_rows(spark, sf), "fraud_indicator")
    rows = t.withColumns({"_r": F.col("transaction_id"), "_v": N.vector_of(["amount"])})
    counts = written(N.majority_neighbours(rows, "transaction_id", "fraud_indicator", minority), "adasyn-weights")
    dealt = N.largest_remainder(counts, "_majority", n_maj - n_min, "transaction_id")
    return dealt.select("transaction_id", F.col("_majority").alias("majority"), F.col("_n").alias("new_rows"))
