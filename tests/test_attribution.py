"""Shapley values against enumeration of all coalitions; tree attribution against the trees' own expectation."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from risklib.ml import attribution as AT
from risklib.ml.models import linear_contributions

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(240, 4)), 2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float) * (x[:, 2] > -1)
    data = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, d double, label double")
    return VectorAssembler(inputCols=COLS, outputCol="features").transform(df)


def enumerated(value, d):
    """Shapley values of a set function."""
    out = np.zeros(d)
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        for k in range(d):
            for s in itertools.combinations(rest, k):
                out[i] += math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) * (value({*s, i}) - value(set(s)))
    return out


def test_all_orders_equal_enumeration(spark, rows):
    game = "a * b + CASE WHEN c > 0 THEN d ELSE 1.0 END"
    ground = rows.where("id < 3")
    out = AT.shapley_values(rows.where("id >= 235"), lambda d: d.withColumn("f", F.expr(game)), COLS, "id", ground, permutations=24).collect()
    f = lambda v: v[0] * v[1] + (v[3] if v[2] > 0 else 1.0)
    z = [[r[c] for c in COLS] for r in ground.collect()]
    for row in rows.where("id >= 235").collect():
        x = [row[c] for c in COLS]
        want = enumerated(lambda s: np.mean([f([x[j] if j in s else g[j] for j in range(4)]) for g in z]), 4)
        mine = {r["feature"]: r for r in out if r["id"] == row["id"]}
        assert np.allclose([mine[c]["shapley"] for c in COLS], want)
        assert abs(sum(want) - (mine["a"]["prediction"] - mine["a"]["base_value"])) < 1e-9 and mine["a"]["std_error"] == 0


def test_sampled_orders_of_a_linear_model_are_its_contributions(spark, rows):
    m = LogisticRegression().fit(rows)
    ground = rows.where("id % 30 = 0")
    out = AT.shapley_values(rows, AT.model_score(m, COLS), COLS, "id", ground, permutations=2)
    means = ground.agg(*[F.avg(c).alias(c) for c in COLS]).first()
    got = {(r["id"], r["feature"]): r for r in out.collect()}
    coefs = dict(zip(COLS, m.coefficients.toArray()))
    for r in rows.limit(20).collect():
        for c in COLS:
            assert abs(got[r["id"], c]["shapley"] - coefs[c] * (r[c] - means[c])) < 1e-9
    whole = {(r["id"], r["feature"]): r["contribution"] for r in linear_contributions(rows, coefs, "id").collect()}
    shift = {c: coefs[c] * (rows.agg(F.avg(c)).first()[0] - means[c]) for c in COLS}
    assert all(abs(got[k]["shapley"] - v - shift[k[1]]) < 1e-9 for k, v in whole.items())


def test_sampled_values_add_up_and_lie_within_their_error(spark, rows):
    game = lambda d: d.withColumn("f", F.expr("a * b * c + d"))
    ground = rows.where("id < 10")
    some = rows.where("id >= 230")
    full = {(r["id"], r["feature"]): r["shapley"] for r in AT.shapley_values(some, game, COLS, "id", ground, permutations=24).collect()}
    out = AT.shapley_values(some, game, COLS, "id", ground, permutations=6).collect()
    near = [abs(r["shapley"] - full[r["id"], r["feature"]]) <= 5 * r["std_error"] + 1e-9 for r in out]
    assert sum(near) >= 0.95 * len(near) and any(r["std_error"] > 0 for r in out)
    sums = {}
    for r in out:
        sums.setdefault(r["id"], [0, r["prediction"] - r["base_value"]])[0] += r["shapley"]
    assert all(abs(a - b) < 1e-9 for a, b in sums.values())
    with pytest.raises(ValueError):
        AT.shapley_values(some, game, COLS, "id", rows)


def tree_value(leaves, x, known):
    """Expectation of the trees where only ``known`` features are known, from the leaves' rules."""
    total = 0.0
    for leaf in leaves:
        p = leaf["value"]
        for f, r in zip(leaf["features"], leaf["rules"]):
            p *= float(r["low"] < x[f] <= r["high"]) if f in known else r["share"]
        total += p
    return total


@pytest.mark.parametrize("model", [lambda: DecisionTreeClassifier(maxDepth=4), lambda: RandomForestClassifier(numTrees=4, maxDepth=4, seed=1),
                                   lambda: GBTClassifier(maxIter=4, maxDepth=3, seed=1)])
def test_tree_attribution_equals_enumeration(spark, rows, model):
    m = model().fit(rows)
    leaves, base = AT.tree_leaves(m)
    assert abs(base - tree_value(leaves, [0.0] * 4, set())) < 1e-12
    out = AT.tree_attribution(m, rows, COLS, "id").collect()
    got = {(r["id"], r["feature"]): r["contribution"] for r in out}
    col = "rawPrediction" if "GBT" in type(m).__name__ else "probability"
    own = {r["id"]: r["p"] for r in m.transform(rows).select("id", vector_to_array(col)[1].alias("p")).collect()}
    assert all(abs(r["prediction"] - own[r["id"]]) < 1e-9 for r in out)
    for r in rows.limit(25).collect():
        x = [r[c] for c in COLS]
        want = enumerated(lambda s: tree_value(leaves, x, s), 4)
        assert np.allclose([got[r["id"], c] for c in COLS], want, atol=1e-12)


def test_categorical_splits_and_a_single_leaf(spark):
    from pyspark.ml.feature import StringIndexer
    data = [(i, "pqrs"[i % 4], float(i % 7), float(i % 4 in (1, 2))) for i in range(80)]
    df = spark.createDataFrame(data, "id long, g string, x double, label double")
    df = StringIndexer(inputCol="g", outputCol="gi").fit(df).transform(df)
    df = VectorAssembler(inputCols=["gi", "x"], outputCol="features").transform(df)
    m = RandomForestClassifier(numTrees=3, maxDepth=3, seed=2).fit(df)
    own = {r["id"]: r["p"] for r in m.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    assert all(abs(r["prediction"] - own[r["id"]]) < 1e-9 for r in AT.tree_attribution(m, df, ["g", "x"], "id").collect())
    flat = DecisionTreeClassifier(maxDepth=2).fit(df.withColumn("features", df["features"]).withColumn("label", F.lit(1.0)))
    out = AT.tree_attribution(flat, df, ["g", "x"], "id").collect()
    assert all(r["contribution"] == 0 and abs(r["prediction"] - 1) < 1e-12 for r in out)


def test_leaf_shares_beyond_the_table_of_patterns():
    rng = np.random.default_rng(0)
    m = AT.ALL_PATTERNS + 2
    leaf = {"value": 1.5, "features": list(range(m)), "rules": [{"share": s, "low": 0.0, "high": math.inf, "cats": None} for s in rng.uniform(0.1, 0.9, m)]}
    x = rng.normal(size=(30, m))
    phi = AT.attribute(x, [leaf], {})
    share = np.array([r["share"] for r in leaf["rules"]])
    assert np.allclose(phi.sum(axis=1), 1.5 * (np.prod(x > 0, axis=1) - np.prod(share)))


def test_exact_shapley_scores_each_set_of_features_once(spark):
    rows = spark.range(20).select("id", *[(F.col("id") * (i + 1) % 7).cast("double").alias(c) for i, c in enumerate(("a", "b", "c"))])
    scored = []

    def score(d):
        scored.append(d)
        return d.withColumn("f", F.expr("a * b + c"))

    out = AT.shapley_values(rows, score, ["a", "b", "c"], "id", rows.where("id < 2"), permutations=6)
    assert out.count() == 60 and scored[-1].count() == 20 * (2 * 6 + 1)  # the whole set once, the empty one on the background alone
