"""Shapley attribution (EVA19): any scoring function by permutations, tree models exactly from their nodes."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklib.operators.keyed import written
from risklib.session import scratch_path

MAX_BACKGROUND = 100
SEED = 42
SETS_AT_ONCE = 64  # sets of features whose rows are built at once
ALL_PATTERNS = 10  # leaves with at most so many features have the shares of every pattern worked out beforehand


def model_score(model: Model, cols: Sequence[str], scale: str = "margin") -> Callable[[DataFrame], DataFrame]:
    """A scoring function for ``shapley_values``: the positive class's raw prediction ("margin") or probability."""
    out = {"margin": "rawPrediction", "probability": "probability"}[scale]
    assembler = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")

    def score(df: DataFrame) -> DataFrame:
        return model.transform(assembler.transform(df)).withColumn("f", vector_to_array(out)[1])

    return score


def _walks(n_background: int, d: int, permutations: int, seed: int) -> list[tuple[int, int, list[int]]]:
    """(pair, background row, order of the features): seeded orders and their reverses."""
    rng = np.random.default_rng(seed)
    out = []
    for z in range(n_background):
        for _ in range(max(1, permutations // 2)):
            p = rng.permutation(d).tolist()
            pair = len(out) // 2
            out += [(pair, z, p), (pair, z, p[::-1])]
    return out


def shapley_values(df: DataFrame, score: Callable[[DataFrame], DataFrame], cols: Sequence[str], key: str,
                   background: DataFrame, permutations: int = 8, seed: int = SEED) -> DataFrame:
    """(key, feature, shapley, std_error, base_value, prediction) of every row of ``df`` and column of ``cols``.

    ``score`` adds a column ``f`` to rows with ``cols``. A feature's value for a row is its marginal gain, averaged over
    orders of the features and over the rows of ``background`` (at most ``MAX_BACKGROUND``), which give the values of
    features that are not yet in. Per background row and order, a row becomes one row per prefix; all of them are scored
    in one pass, and the gains are differences of neighbouring prefixes. The gains of a row add up to
    prediction - base_value, the mean score of the background, whatever the orders. With at most
    ``permutations`` orders in all they are all taken, each set of features scored once, and the values are exact for the
    background (std_error 0); otherwise orders come with their reverses, and std_error is that of the mean over such pairs.
    A pair with a null score counts for nothing.
    """
    cols = list(cols)
    d = len(cols)
    ground = background.select(*[F.col(f"`{c}`").cast("double") for c in cols]).limit(MAX_BACKGROUND + 1).collect()
    if not 0 < len(ground) <= MAX_BACKGROUND:
        raise ValueError(f"the background needs 1 to {MAX_BACKGROUND} rows")
    z = np.array([[np.nan if v is None else v for v in r] for r in ground], float)
    exact = math.factorial(d) <= permutations
    alone = df.sparkSession.createDataFrame([(i, *map(float, r)) for i, r in enumerate(z)], "_z int, " + ", ".join(f"`{c}` double" for c in cols))
    empty = {r["_z"]: math.nan if r["f"] is None else float(r["f"]) for r in score(alone).select("_z", F.col("f").cast("double")).collect()}
    steps = _all_sets(empty, d) if exact else _sampled_sets(empty, d, permutations, seed)
    units = [list(g) for _, g in itertools.groupby(steps, lambda s: s[0])]
    batches_of = [(u[i:i + SETS_AT_ONCE]) for u in units for i in range(0, len(u), SETS_AT_ONCE)]
    names = [f"_x{i}" for i in range(d)]
    rows = written(df.select(F.col(key), *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(cols, names)]).withColumn(
        "_r", F.monotonically_increasing_id()), "shapley-rows")

    def prefixes(batches):
        for b in batches:
            n = b.num_rows
            x = np.stack([np.asarray(b.column(i + 1).cast(pa.float64()).fill_null(np.nan)) for i in range(d)], axis=1)
            for sets in batches_of:
                unit, at, inside, plus, minus, gain, loss, less = (np.array(v) for v in zip(*sets))
                v = np.where(inside[None], x[:, None, :], z[at][None]).reshape(-1, d)
                every = lambda a, t: pa.array(np.tile(a.astype(t), n))
                yield pa.record_batch({
                    "_r": pa.array(np.repeat(np.asarray(b.column(0)), len(sets))), "_unit": every(unit, np.int32), "_plus": every(plus, np.int32),
                    "_minus": every(minus, np.int32), "_less": every(less, float), "_whole": every(inside.all(axis=1), bool),
                    **({"_gain": every(gain, float), "_loss": every(loss, float)} if exact else {}),
                    **{c: pa.array(v[:, i]) for i, c in enumerate(cols)}})

    schema = "_r long, _unit int, _plus int, _minus int, _less double, _whole boolean, " + ("_gain double, _loss double, " if exact else "") + ", ".join(
        f"`{c}` double" for c in cols)
    scored = score(rows.select("_r", *names).mapInArrow(prefixes, schema)).withColumn("f", F.col("f").cast("double"))

    def has(which, i):  # in the exact case every set of features, else a single one
        return F.col(which).bitwiseAND(1 << i) != 0 if exact else F.col(which) == i

    gain, loss = (F.col("_gain"), F.col("_loss")) if exact else (F.lit(0.5), F.lit(0.5))
    # sums of gains: a row's sets come from one task, so they are combined there and the scored rows are never shuffled
    sums = [F.sum(F.when(has("_plus", i), gain * (F.col("f") - F.col("_less"))).otherwise(0.0)
                  + F.when(has("_minus", i), -loss * F.col("f")).otherwise(0.0)).alias(f"_g{i}") for i in range(d)]
    pairs = scored.groupBy("_r", "_unit").agg(*sums, F.max(F.when(F.col("_whole"), F.col("f"))).alias("_fd"), F.count_if(F.col("f").isNull()).alias("_none"))
    if exact:  # a single unit
        values = pairs.select("_r", "_fd", *[F.when(F.col("_none") == 0, F.col(f"_g{i}")).alias(f"_m{i}") for i in range(d)],
                              *[F.lit(0.0).alias(f"_e{i}") for i in range(d)])
    else:
        g = [F.when(F.col("_none") == 0, F.col(f"_g{i}")) for i in range(d)]
        values = pairs.groupBy("_r").agg(F.max("_fd").alias("_fd"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(g)], *[F.coalesce(
            F.stddev_samp(c) / F.sqrt(F.count(c)), F.lit(0.0)).alias(f"_e{i}") for i, c in enumerate(g)])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_m{i}").alias("shapley"), F.col(f"_e{i}").alias("std_error"))
                                for i, c in enumerate(cols)])).alias("_c")
    return rows.select("_r", key).join(values, "_r").select(key, cells, F.lit(float(np.mean(list(empty.values())))).alias("base_value"), F.col(
        "_fd").alias("prediction")).select(key, "_c.*", "base_value", "prediction")


def _all_sets(empty: dict[int, float], d: int) -> list[tuple]:
    """Every set of features once per background row, the whole set once in all, as (unit, background row, inside, features
    that gain, features that lose, weight of the gains, of the losses, score of the empty set to take off)."""
    n = len(empty)
    weight = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
    out = []
    for at, s in itertools.product(empty, range(1, (1 << d) - 1)):
        k = s.bit_count()
        out.append((0, at, [bool(s >> i & 1) for i in range(d)], s, ~s & ((1 << d) - 1), weight[k - 1] / n, weight[k] / n, empty[at] if k == 1 else 0.0))
    mean = sum(empty.values()) / n
    return [*out, (0, 0, [True] * d, (1 << d) - 1, 0, weight[d - 1], 0.0, mean if d == 1 else 0.0)]


def _sampled_sets(empty: dict[int, float], d: int, permutations: int, seed: int) -> list[tuple]:
    """The prefixes of the walks as in ``_all_sets``, a unit being a pair of orders; the empty ones are known scores."""
    out = []
    for pair, at, p in _walks(len(empty), d, permutations, seed):
        place = np.argsort(p)
        for j in range(1, d + 1):
            out.append((pair, at, (place < j).tolist(), p[j - 1], p[j] if j < d else -1, 0.5, 0.5, empty[at] if j == 1 else 0.0))
    return out


# ---------------------------------------------------------------- trees
def tree_leaves(model: Model) -> tuple[list[dict], float]:
    """The leaves of a fitted tree model, and the mean prediction by training weight.

    Per leaf: ``value`` (its share of the model's output), ``features`` of its path, each with the ``share`` of training
    weight that its splits let through, and the values it takes (``low`` < x <= ``high``, or ``cats``).
    Forests and single trees: probability of the positive class; boosted trees: the margin, as in rawPrediction.
    """
    path = scratch_path_of(model)
    model.write().overwrite().save(path)
    from pyspark.sql import SparkSession
    data = SparkSession.getActiveSession().read.parquet(f"{path}/data")
    rows = [r.asDict(recursive=True) for r in data.collect()]  # the nodes of the model
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        node = r.get("nodeData", r)
        trees.setdefault(r.get("treeID", 0), {})[node["id"]] = node
    boosted = hasattr(model, "treeWeights") and "GBT" in type(model).__name__
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    total = 1.0 if boosted else sum(weights)
    leaves, base = [], 0.0
    for t, nodes in sorted(trees.items()):
        weigh = {i: (n["impurityStats"][0] if boosted else sum(n["impurityStats"])) for i, n in nodes.items()}
        stack = [(0, 1.0, {})]
        while stack:
            i, reach, rules = stack.pop()
            n = nodes[i]
            if n["leftChild"] < 0:
                out = n["prediction"] if boosted else n["impurityStats"][1] / max(sum(n["impurityStats"]), 1e-300)
                value = out * weights[t] / total
                base += value * reach
                leaves.append({"value": value, "features": sorted(rules), "rules": [rules[f] for f in sorted(rules)]})
                continue
            split = n["split"]
            f, cats = split["featureIndex"], split["numCategories"]
            for child, left in ((n["leftChild"], True), (n["rightChild"], False)):
                share = weigh[child] / weigh[i]
                old = rules.get(f, {"share": 1.0, "low": -math.inf, "high": math.inf, "cats": None})
                new = dict(old, share=old["share"] * share)
                if cats < 0:
                    at = split["leftCategoriesOrThreshold"][0]
                    new.update({"high": min(old["high"], at)} if left else {"low": max(old["low"], at)})
                else:
                    here = set(split["leftCategoriesOrThreshold"]) if left else set(range(cats)) - set(split["leftCategoriesOrThreshold"])
                    new["cats"] = here if old["cats"] is None else old["cats"] & here
                stack.append((child, reach * share, {**rules, f: new}))
    return leaves, base


def scratch_path_of(model: Model) -> str:
    from pyspark.sql import SparkSession
    return scratch_path(SparkSession.getActiveSession(), "tree-nodes")


def leaf_shares(held: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of the game ``prod(held_i for i in S) * prod(share_i for the others)``, for rows of 0/1 ``held`` [rows, m].

    For feature i: (held_i - share_i) times the sum over k of k! (m - k - 1)! / m! and the coefficient of t**k
    in the product of (share_j + held_j t) over the other features.
    """
    rows, m = held.shape
    weight = np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])
    out = np.empty((rows, m))
    for i in range(m):
        c = np.zeros((rows, m))
        c[:, 0] = 1
        for j in range(m):
            if j != i:
                c[:, 1:] = c[:, 1:] * share[j] + c[:, :-1] * held[:, j:j + 1]
                c[:, 0] *= share[j]
        out[:, i] = (held[:, i] - share[i]) * (c @ weight)
    return out


def attribute(x: np.ndarray, leaves: list[dict], memo: dict) -> np.ndarray:
    """Attribution [rows, features] of all leaves; the shares of a pattern of held features are worked out once."""
    out = np.zeros(x.shape)
    for k, leaf in enumerate(leaves):
        m = len(leaf["features"])
        if not m:
            continue
        held = np.empty((len(x), m), bool)
        for i, (f, r) in enumerate(zip(leaf["features"], leaf["rules"])):
            v = x[:, f]
            # a missing value goes right at every split
            held[:, i] = (np.isin(v, list(r["cats"])) if r["cats"] is not None
                          else ~(v <= r["low"]) & ((v <= r["high"]) | (r["high"] == math.inf)))
        share = np.array([r["share"] for r in leaf["rules"]])
        if m <= ALL_PATTERNS:
            if k not in memo:
                every = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
                memo[k] = leaf_shares(every, share) * leaf["value"]
            got = memo[k][held @ (1 << np.arange(m))]
        else:
            kinds, at = np.unique(held, axis=0, return_inverse=True)
            got = (leaf_shares(kinds.astype(float), share) * leaf["value"])[at.ravel()]
        for i, f in enumerate(leaf["features"]):
            out[:, f] += got[:, i]
    return out


def tree_attribution(model: Model, df: DataFrame, feature_names: Sequence[str], key: str, features: str = "features") -> DataFrame:
    """(key, feature, contribution, base_value, prediction) of every row: path-dependent Shapley values of a tree model.

    A feature that is not known sends a row down both sides of a split, by the training weight of either side. Contributions
    of a row add up to prediction - base_value: the probability of a forest or tree, the margin of boosted trees.
    The nodes of the model reach the tasks; rows are worked on in Arrow batches.
    """
    leaves, base = tree_leaves(model)
    names = pa.array(list(feature_names))
    d = len(feature_names)
    memo: dict = {}

    def run(batches):
        for b in batches:
            n = b.num_rows
            x = np.asarray(b.column(1).flatten()).reshape(n, d)
            phi = attribute(x, leaves, memo)
            yield pa.record_batch({
                "_k": b.column(0).take(pa.array(np.repeat(np.arange(n), d))), "feature": names.take(pa.array(np.tile(np.arange(d), n))),
                "contribution": pa.array(phi.ravel()), "base_value": pa.array(np.full(n * d, base)),
                "prediction": pa.array(np.repeat(phi.sum(axis=1) + base, d))})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_k"), vector_to_array(features).alias("x")).mapInArrow(
        run, f"_k {kind}, feature string, contribution double, base_value double, prediction double").withColumnRenamed("_k", key)
