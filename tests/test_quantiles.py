"""Exact quantiles against numpy: ties, nulls, groups, several parts, empty tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklib.operators.clean import impute
from risklib.operators.quantiles import fit_quantiles, quantile_table

PROBS = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b", None]), None if i % 9 == 0 else rnd.choice([1.5, rnd.gauss(0, 50)]), rnd.randint(0, 3))
            for i in range(700)]
    return spark.createDataFrame(rows, "id long, g string, x double, k int").repartition(3), rows


@pytest.mark.parametrize("limit", [1_000_000, 30])
def test_equals_numpy(data, limit):
    df, rows = data
    got = {(r["column"], r.g): r.q for r in quantile_table(df, ["x", "k"], PROBS, ["g"], rows_per_part=limit).collect()}
    for g in ("a", "b", None):
        for i, c in ((2, "x"), (3, "k")):
            want = np.quantile([r[i] for r in rows if r[1] == g and r[i] is not None], PROBS)
            assert np.allclose(got[c, g], want, rtol=1e-12, atol=1e-12)


def test_without_values(data):
    df, _ = data
    empty = df.where("id < 0")
    assert fit_quantiles(empty, ["x", "k"], [0.5]) == {"x": None, "k": None}
    assert fit_quantiles(df, [], [0.5]) == {}
    nulls = df.withColumn("x", F.lit(None).cast("double"))
    assert impute(nulls, ["x", "k"], []).where("x IS NULL").count() == 700
    assert impute(df, ["x"], ["g"]).where("x IS NULL OR g IS NULL").count() == 0
