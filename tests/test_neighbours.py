"""Nearest neighbours against brute force; invariants of SMOTE and ADASYN."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklib import api
from risklib.operators import neighbours as N

SF01 = "/root/testdata/sf0.1"


def frame(spark, v):
    return spark.createDataFrame([(i, [float(c) for c in r], True) for i, r in enumerate(v)], "r long, v array<double>, ask boolean")


def brute(v, k):
    d = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return [sorted(zip(d[i], range(len(v))))[:min(k, len(v) - 1)] for i in range(len(v))]


@pytest.mark.parametrize("n,d", [(1, 3), (2, 1), (4, 2), (120, 5), (300, 1)])
def test_few_rows_are_exact(spark, n, d):
    rng = np.random.default_rng(n)
    v = np.round(rng.normal(size=(n, d)), 1)  # many ties
    got = collections.defaultdict(list)
    for r in N.nearest_neighbours(frame(spark, v).repartition(3), 5).orderBy("r", "rank").collect():
        got[r["r"]].append((r["distance"], r["neighbour"]))
    want = brute(v, 5)
    for i in range(n):
        assert [b for _, b in got[i]] == [b for _, b in want[i]]
        assert np.allclose([a for a, _ in got[i]], [a for a, _ in want[i]])


def test_only_asking_rows_and_whole_vectors_take_part(spark):
    rows = [(i, [float(i)], i % 2 == 0) for i in range(9)] + [(50, None, True)]
    out = N.nearest_neighbours(spark.createDataFrame(rows, "r long, v array<double>, ask boolean"), 2).collect()
    assert {r["r"] for r in out} == {0, 2, 4, 6, 8} and 50 not in {r["neighbour"] for r in out}
    none = spark.createDataFrame([], "r long, v array<double>, ask boolean")
    assert N.nearest_neighbours(none).count() == 0


def test_places_do_not_depend_on_the_number_of_partitions(spark):
    v = np.random.default_rng(5).normal(size=(400, 4))
    a = {(r["r"], r["rank"]): r["neighbour"] for r in N.nearest_neighbours(frame(spark, v).coalesce(1), 3, block=64).collect()}
    b = {(r["r"], r["rank"]): r["neighbour"] for r in N.nearest_neighbours(frame(spark, v).repartition(7), 3, block=64).collect()}
    assert a == b


def test_recall_on_embeddings(spark):
    """The 5 nearest of 5,000 vectors of 64 places, ten times the block, against brute force."""
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    v = np.array([r["embedding"] for r in e.orderBy("vec_id").collect()], float)
    ids = [r["vec_id"] for r in e.select("vec_id").orderBy("vec_id").collect()]
    got = collections.defaultdict(set)
    for r in N.nearest_neighbours(e.select(F.col("vec_id").alias("r"), F.col("embedding").cast("array<double>").alias("v"), F.lit(True).alias("ask"))).collect():
        got[r["r"]].add(r["neighbour"])
    size = (v * v).sum(axis=1)
    d = size[:, None] + size[None, :] - 2 * v @ v.T
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :5]
    hits = sum(len(got[ids[i]] & {ids[j] for j in near[i]}) for i in range(len(v)))
    assert hits / (5 * len(v)) >= 0.9


SCHEMA = "transaction_id long, fraud_indicator int, x double, y double, name string"


def classes(spark, n_min=23, n_maj=140):
    rng = np.random.default_rng(2)
    rows = [(i, 1, float(a), float(b), f"m{i}") for i, (a, b) in enumerate(rng.normal(size=(n_min, 2)))]
    rows += [(1000 + i, 0, float(a), float(b), f"n{i}") for i, (a, b) in enumerate(rng.normal(0.8, 1, size=(n_maj, 2)))]
    rows += [(2000, 1, None, 1.0, "hole"), (2001, None, 0.0, 0.0, "unlabelled"), (2002, 0, 1.0, None, "hole")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("method", ["smote", "adasyn"])
def test_classes_are_equal_and_new_rows_lie_between_minority_rows(spark, method):
    df = classes(spark)
    out = api.handle_class_imbalance(df, "transaction_id", method=method, cols=["x", "y"]).collect()
    counts = collections.Counter(r["fraud_indicator"] for r in out)
    assert counts[0] == counts[1] == 141 and counts[None] == 1
    old = [r for r in out if r["copy"] == 0]
    assert len(old) == df.count() and all(r["gap"] is None and r["neighbour"] is None for r in old)
    whole = {r["transaction_id"]: (r["x"], r["y"]) for r in old if r["fraud_indicator"] == 1 and r["x"] is not None}
    v = np.array(list(whole.values()))
    near = {k: {list(whole)[j] for _, j in w} for k, w in zip(whole, brute(v, 5))}
    for r in out:
        if r["copy"]:
            a, b, g = np.array(whole[r["transaction_id"]]), np.array(whole[r["neighbour"]]), r["gap"]
            assert r["neighbour"] in near[r["transaction_id"]] and 0 <= g < 1
            assert np.allclose([r["x"], r["y"]], a + g * (b - a)) and r["name"] == f"m{r['transaction_id']}"
    again = api.handle_class_imbalance(df.repartition(5), "transaction_id", method=method, cols=["x", "y"]).collect()
    key = lambda rows: sorted((r["transaction_id"], r["copy"], r["neighbour"] or -1, r["x"] or 0.0) for r in rows)
    assert key(out) == key(again)


def test_adasyn_follows_the_majority_share(spark):
    rows = [(i, 1, float(i) / 100, 0.0, "far") for i in range(20)] + [(50 + i, 1, 100.0 + i, 0.0, "near") for i in range(5)]
    rows += [(100 + i, 0, 100.5 + i / 10, 0.0, "n") for i in range(60)]
    out = api.handle_class_imbalance(spark.createDataFrame(rows, SCHEMA), "transaction_id", method="adasyn", cols=["x", "y"])
    assert {r["name"] for r in out.where("copy > 0").collect()} == {"near"}
    assert out.where("fraud_indicator = 1").count() == 60


def test_largest_remainder_counts(spark):
    rows = [(i, w) for i, w in enumerate([5, 5, 3, 1, 0, 0, 4, None])]
    df = spark.createDataFrame(rows, "k long, w long")
    for total in (0, 1, 7, 18, 100):
        out = {r["k"]: r["_n"] for r in N.largest_remainder(df, "w", total, "k").collect()}
        assert sum(out.values()) == total
        assert all(abs(out[k] - total * (w or 0) / 18) < 1 for k, w in rows)
    assert sum(r["_n"] for r in N.largest_remainder(df.where("w = 0"), "w", 5, "k").collect()) == 0


def test_too_few_minority_rows_are_an_error(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, "a"), (2, 0, 0.0, 0.0, "b"), (3, 0, 1.0, 0.0, "c")], SCHEMA)
    for method in ("smote", "adasyn"):
        with pytest.raises(ValueError):
            api.handle_class_imbalance(df, "transaction_id", method=method, cols=["x", "y"])
    even = df.where("transaction_id < 3")
    assert api.handle_class_imbalance(even, "transaction_id", method="smote", cols=["x", "y"]).count() == 2


def test_rows_meet_their_half_block_and_the_two_beside_it(spark):
    """Beyond one group the neighbours along one coordinate are those of the three half blocks, also across the edges of groups."""
    n, half = 1_200, 16  # five groups
    v = np.random.default_rng(8).normal(size=(n, 1))
    got = collections.defaultdict(list)
    for r in N.nearest_neighbours(frame(spark, v), 5, block=2 * half).orderBy("r", "rank").collect():
        got[r["r"]].append(r["neighbour"])
    order = np.argsort(v[:, 0])
    if v[order[0]] @ np.random.default_rng(N.SEED).normal(size=(1, 1)) > v[order[-1]] @ np.random.default_rng(N.SEED).normal(size=(1, 1)):
        order = order[::-1]
    for place, i in enumerate(order):
        h = place // half
        near = [j for j in order[max(0, (h - 1) * half):(h + 2) * half] if j != i]
        assert got[i] == sorted(near, key=lambda j: (abs(v[j, 0] - v[i, 0]), j))[:5]


def test_many_copies_of_few_points_are_compared_once(monkeypatch):
    """Ties go to the earlier row, and only k + 1 copies of a point are candidates."""
    v = np.repeat(np.round(np.random.default_rng(4).normal(size=(9, 3)), 1), [1, 2, 5, 6, 7, 20, 40, 60, 1], axis=0)
    v = v[np.random.default_rng(5).permutation(len(v))]
    ask = np.arange(len(v)) % 3 > 0
    seen = []
    cut = N.first_copies
    monkeypatch.setattr(N, "first_copies", lambda v, k: (seen.append(cut(v, k)), seen[-1])[1])
    row, col, away = N.nearest_in(v, ask, 5)
    assert len(seen[0]) == 1 + 2 + 5 + 6 * 5 + 1
    want = brute(v, 5)
    for i in np.flatnonzero(ask):
        assert col[row == i].tolist() == [j for _, j in want[i]]
        assert np.allclose(away[row == i], [a for a, _ in want[i]])


def exact(v, ask, k):
    """The k nearest of every asking row, a row at a time."""
    out = {}
    for i in np.flatnonzero(ask):
        d = np.sqrt(((v - v[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        out[int(i)] = np.lexsort((np.arange(len(v)), d))[:k].tolist()
    return out


@pytest.mark.parametrize("cells", [False, True])
def test_many_coordinates_and_rows_are_exact(spark, monkeypatch, cells):
    """Far more rows than a block, in one cell and in several that rows at every edge ask."""
    if cells:
        monkeypatch.setattr(N, "CELL_ROWS", 300)
        monkeypatch.setattr(N, "LEAST_CELL", 100)
    v = np.random.default_rng(11).normal(size=(3_000, 12))
    got = collections.defaultdict(list)
    for r in N.nearest_neighbours(frame(spark, v), 5).orderBy("r", "rank").collect():
        got[r["r"]].append(r["neighbour"])
    assert got == exact(v, np.ones(len(v), bool), 5)


def test_repeated_numbers_and_unusable_vectors(spark):
    rows = [(1, [0.0, 0.0], True), (1, [0.0, 0.0], True), (2, [1.0, 0.0], True), (3, [4.0, 0.0], False), (None, [0.5, 0.0], True),
            (5, [float("nan"), 0.0], True), (6, [0.0, float("inf")], True), (7, [0.0, None], True)]
    out = N.nearest_neighbours(spark.createDataFrame(rows, "r long, v array<double>, ask boolean"), 2)
    assert sorted((r["r"], r["rank"], r["neighbour"], r["distance"]) for r in out.collect()) == [
        (1, 1, 1, 0.0), (1, 2, 2, 1.0), (2, 1, 1, 1.0), (2, 2, 3, 3.0)]


@pytest.mark.parametrize("dims,cells", [(1, False), (3, False), (3, True)])
def test_majority_neighbours_are_exact_on_many_ties(spark, monkeypatch, dims, cells):
    """Points on a grid, one of them held by more rows than a block: ties go to the lowest row number, wherever its row lies."""
    if cells:
        monkeypatch.setattr(N, "CELL_ROWS", 100)
        monkeypatch.setattr(N, "LEAST_CELL", 50)
    rng = np.random.default_rng(12)
    v = np.round(rng.normal(size=(4_000, dims)) * [3.0, 2.0, 9.0][:dims], 0)
    v[rng.permutation(4_000)[:900]] = v[0]
    y = (rng.random(4_000) < 0.25).astype(int)
    rows = spark.createDataFrame([(i, int(y[i]), [float(c) for c in v[i]]) for i in range(len(v))], "_r long, y int, _v array<double>").repartition(5)
    got = {r["_r"]: r["_majority"] for r in N.majority_neighbours(rows, "_r", "y", 1).collect()}
    assert got == {i: int((y[near] == 0).sum()) for i, near in exact(v, y == 1, 5).items()}


@pytest.mark.parametrize("dims", [1, 2])
def test_copies_count_as_rows_where_they_are_asked_for(spark, dims):
    rows = [(r, [float(x)] + [0.0] * (dims - 1), True) for r, x in ((1, 0), (1, 0), (2, 1), (2, 1), (3, 1), (4, 5), (5, 7))]
    def listed(copies):
        out = N.nearest_neighbours(spark.createDataFrame(rows, "r long, v array<double>, ask boolean"), 3, copies=copies).collect()
        return {r: [x["neighbour"] for x in sorted(out, key=lambda x: x["rank"]) if x["r"] == r] for r in range(1, 6)}
    assert listed(True) == {1: [1, 2], 2: [2, 3, 1], 3: [2, 1], 4: [5, 2], 5: [4, 2]}
    assert listed(False) == {1: [1, 2, 3], 2: [2, 3, 1], 3: [2, 1, 4], 4: [5, 2, 3], 5: [4, 2, 3]}
