"""Score ranges follow the scores: crowded scores do not meet in one window."""

import math

import pytest
from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F

from risklib.operators import evaluate as EV


def test_crowded_scores_are_spread(spark):
    df = spark.range(50_000).select((F.when(F.col("id") % 100 > 0, F.col("id") * 1e-9).otherwise(F.col("id") / 50_000)).alias("s"),
                                    (F.col("id") % 7 == 0).cast("int").alias("t"))
    edges = EV.score_ranges(df, "s", 256)
    most = (Bucketizer(splits=edges, inputCol="s", outputCol="b").transform(df).groupBy("b").count().agg(F.max("count")).first()[0])
    assert most <= 3 * 50_000 / 256
    rows = sorted((r["s"], r["t"]) for r in df.collect())
    pos = sum(t for _, t in rows)
    below = u = 0
    for _, t in rows:  # all scores differ but for 0
        u, below = (u + below, below) if t else (u, below + 1)
    got = EV.ranking_metrics(df, (), "t", "s").first()["roc_auc"]
    assert got == pytest.approx(u / (pos * (len(rows) - pos)), abs=1e-6)


def test_few_scores_and_none(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (None, 1), (math.nan, 1)], "s double, t int")
    st = {str(r["score"]): (r["pos"], r["neg"], r["pos_below"], r["neg_below"]) for r in EV.score_table(df, (), "t", "s").collect()}
    assert st == {"0.5": (1, 1, 0, 0), "nan": (1, 0, 1, 1)}
    assert EV.score_table(df.limit(0), (), "t", "s").count() == 0
