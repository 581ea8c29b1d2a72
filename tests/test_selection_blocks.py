"""Neighbour mutual information, Gram-matrix correlations and one-pass rates against brute force."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklib.operators import eda
from risklib.operators import features as FE
from risklib.operators import select as SE
from risklib.operators.keyed import places_in_order, running_total, stats_once
from risklib.operators.quantiles import quantile_table, weighted_quantiles


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute_mi(rows, feature, k=3):
    """(key, x, y) rows; noise as documented."""
    size = 2.0 ** math.ceil(math.log2(max(1.0, sum(abs(x) for _, x, _ in rows) / len(rows))))
    jitter = lambda key: int(hashlib.md5(f"{key}|{feature}".encode()).hexdigest()[:13], 16) / 2 ** 52 - 0.5
    rows = [(x + jitter(key) * (2e-10 * size), y) for key, x, y in rows]
    rows = [r for r in rows if sum(q[1] == r[1] for q in rows) > 1]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    n, total = len(x), 0.0
    for i in range(n):
        mine = np.flatnonzero((y == y[i]) & (np.arange(n) != i))
        kk = min(k, len(mine))
        d = np.sort(np.abs(x[mine] - x[i]))[kk - 1]
        away = np.abs(x - x[i])
        m = int((away < d).sum() if d > 0 else (away == 0).sum())
        total += psi(kk) - psi(len(mine) + 1) - psi(m)
    return max(0.0, psi(n) + total / n)


def test_digamma(spark):
    got = [r["d"] for r in spark.range(1, 400).select("id", SE.digamma(F.col("id")).alias("d")).orderBy("id").collect()]
    assert np.allclose(got, [psi(n) for n in range(1, 400)], atol=1e-11)


@pytest.mark.parametrize("block", [4096, 7])
def test_neighbour_information_equals_brute_force(spark, block):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 500)
    y[:1] = 9  # a class of one row
    y[1:3] = 7  # and one of two
    data = {"a": rng.normal(size=500) + y, "b": rng.integers(0, 12, 500).astype(float), "c": rng.normal(size=500), "d": np.full(500, 2.0)}
    rows = [(i, int(t) if i % 50 else None, *[float(data[c][i]) if (i + j) % 41 else None for j, c in enumerate("abcd")]) for i, t in enumerate(y)]
    df = spark.createDataFrame(rows, "id long, fraud_indicator int, a double, b double, c double, d double")
    got = {r["feature"]: r["score"] for r in SE.neighbour_mutual_information(df.repartition(3), list("abcd"), "id", block=block).collect()}
    for j, c in enumerate("abcd"):
        use = [(r[0], r[j + 2], r[1]) for r in rows if r[1] is not None and r[j + 2] is not None]
        assert abs(got[c] - brute_mi(use, c)) < 1e-4  # a distance that equals another to the last bit may count
    assert got["a"] > got["c"]
    none = SE.neighbour_mutual_information(df.where("a > 100"), ["a"], "id").collect()
    assert [r["score"] for r in none] == [None]


@pytest.mark.parametrize("block", [3, 1024])
def test_correlation_blocks_equal_pairs(spark, block):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 11)) @ rng.normal(size=(11, 11)) + 1e6
    x[:, 5] = 4.25
    rows = [tuple(None if rng.random() < 0.15 else float(c) for c in r) for r in x]
    cols = [f"c{i}" for i in range(11)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    a = {(r["col_a"], r["col_b"]): r["r"] for r in eda.correlation_blocks(df, cols, block).collect()}
    b = {(r["col_a"], r["col_b"]): r["r"] for r in eda.correlation_long(df, cols).collect()}
    assert a.keys() == b.keys()
    for pair, r in b.items():
        if "c5" in pair:
            assert a[pair] is None and (r is None or math.isnan(r))
        else:
            assert abs(a[pair] - r) < 1e-6


def test_300_columns_and_selection_over_them(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 300))
    x[:, 299] = x[:, 0] * 2 + 1
    cols = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    r = {(r["col_a"], r["col_b"]): r["r"] for r in eda.correlation_long(df, cols).collect()}
    assert len(r) == 300 * 299 and abs(r["c0", "c299"] - 1) < 1e-9
    assert np.allclose([r["c3", f"c{j}"] for j in range(4, 300)], np.corrcoef(x.T)[3, 4:])
    drop = {q["feature"] for q in SE.correlated_to_drop(df, cols).where("dropped = 1").collect()}
    assert drop == {"c299"}


def test_rates_of_several_columns_from_one_pass(spark):
    rows = [(i, "pqr"[i % 3], None if i % 4 == 0 else f"s{i % 4}", i % 2 if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "transaction_id long, a string, b string, fraud_indicator int")
    got = FE.rate_stats(df, ["a", "b"])
    for c in ("a", "b"):
        want = df.groupBy(c).agg(F.sum("fraud_indicator").alias("_s"), F.count("fraud_indicator").alias("_n"), F.count(F.lit(1)).alias("_rows"))
        assert sorted(map(str, got[c].select(c, "_s", "_n", "_rows").collect())) == sorted(map(str, want.collect()))
    plan = df.groupingSets([["a"], ["b"]], "a", "b").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") <= 1
    assert {c: t.count() for c, t in stats_once(df, ["a"], [F.count(F.lit(1)).alias("n")]).items()} == {"a": 3}


def test_weighted_quantiles_by_both_ways(spark):
    df = spark.createDataFrame([(float(i % 7), i % 4) for i in range(50)] + [(None, 3)], "x double, w long")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    flat = [x for x, w in [(float(i % 7), i % 4) for i in range(50)] for _ in range(w)]
    assert np.allclose(weighted_quantiles(df, "x", "w", probs), np.quantile(flat, probs))
    assert np.allclose(weighted_quantiles(df, "x", "w", probs, most=3), np.quantile(flat, probs))
    assert weighted_quantiles(df.where("x IS NULL"), "x", "w", probs) is None
    assert np.allclose(quantile_table(df, ["x"], probs).first()["q"], np.quantile([float(i % 7) for i in range(50)], probs))


def test_places_and_running_totals(spark):
    rng = np.random.default_rng(6)
    rows = [(("a", "b", None)[i % 3], float(rng.integers(0, 9)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, x double, w long").repartition(7)
    got = running_total(places_in_order(df, ["k"], ["x", "w"]), ["k"], ["x", "w"], "w", "total").collect()
    for k in ("a", "b", None):
        mine = sorted(r for r in rows if r[0] == k)if k else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:])
        total = 0
        for place, r in enumerate(mine):
            total += r[2]
            one = next(g for g in got if g["w"] == r[2])
            assert (one["place"], one["total"]) == (place, total)
