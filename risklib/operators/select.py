"""Filter-style feature selection (SEL1-SEL5): statistics from single aggregate passes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklib.operators.eda import correlation_long
from risklib.operators.keyed import attach_stats, places_in_order, running_total, written
from risklib.operators.neighbours import unit_hash
from risklib.operators.quantiles import bin_of, fit_quantiles
from risklib.schema import LABEL


def _long(one: DataFrame, cols: Sequence[str], fields: Sequence[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in cols])
    return one.select(F.explode(arr).alias("x")).select("x.*")


# ---------------------------------------------------------------- SEL1
def variance_threshold(df: DataFrame, cols: Sequence[str], threshold: float = 0.01) -> DataFrame:
    one = df.agg(*[F.var_pop(F.col(c).cast("double")).alias(f"{c}__variance") for c in cols])
    return _long(one, cols, ["variance"]).withColumn("selected", (F.col("variance") > threshold).cast("int"))


# ---------------------------------------------------------------- SEL2
def correlated_to_drop(df: DataFrame, cols: Sequence[str], threshold: float = 0.95, target: str | None = LABEL) -> DataFrame:
    """A column is dropped when |r| > threshold with any EARLIER column (upper-triangle rule)."""
    cols = [c for c in cols if c != target]
    pos = {c: i for i, c in enumerate(cols)}
    corr = correlation_long(df, cols)
    order = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
    hit = corr.where((order[F.col("col_a")] < order[F.col("col_b")]) & (F.abs("r") > threshold))
    drop = hit.groupBy(F.col("col_b").alias("feature")).agg(F.count(F.lit(1)).alias("_n"))
    feats = corr.select(F.col("col_a").alias("feature")).distinct()
    return feats.join(drop, "feature", "left").select("feature", F.col("_n").isNotNull().cast("int").alias("dropped"))


# ---------------------------------------------------------------- SEL3
def anova_f(df: DataFrame, cols: Sequence[str], label: str = LABEL, k: int | None = None) -> DataFrame:
    """One-way ANOVA F per feature from per-class counts (of the feature's own non-null rows), means and
    population variances, which keep their digits where sums of squares would cancel."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__n"), F.avg(x).alias(f"{c}__m"), F.var_pop(x).alias(f"{c}__v")]
    g = df.where(F.col(label).isNotNull()).groupBy(label).agg(*aggs)
    w = Window.partitionBy()  # one row per class
    for c in cols:
        n, m = F.col(f"{c}__n"), F.col(f"{c}__m")
        g = g.withColumn(f"{c}__g", F.sum(n * m).over(w) / F.sum(n).over(w))
    one = []
    for c in cols:
        n = F.col(f"{c}__n")
        one += [F.sum(n).alias(f"{c}__N"), F.sum((n > 0).cast("int")).alias(f"{c}__K"),
                F.sum(n * F.pow(F.col(f"{c}__m") - F.col(f"{c}__g"), 2)).alias(f"{c}__B"), F.sum(n * F.col(f"{c}__v")).alias(f"{c}__W")]
    tot = g.agg(*one)
    rows = []
    for c in cols:
        n_classes = F.col(f"{c}__K")
        f = F.try_divide(F.try_divide(F.col(f"{c}__B"), n_classes - 1),
                         F.try_divide(F.col(f"{c}__W"), F.col(f"{c}__N") - n_classes))
        rows.append(F.struct(F.lit(c).alias("feature"), f.alias("score")))
    out = tot.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return _rank(out, k)


def _rank(scores: DataFrame, k: int | None) -> DataFrame:
    # scores equal up to summation order (e.g. monotone transforms of one feature) tie -> by name
    r = scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round("score", 9)), "feature")))
    return r.where(F.col("rank") <= k) if k else r


# ---------------------------------------------------------------- SEL4
def chi2(df: DataFrame, cols: Sequence[str], label: str = LABEL, k: int | None = None) -> DataFrame:
    """sklearn's chi2: observed per-class sums of each (non-negative) feature vs class share x total, over labelled rows."""
    g = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).cast("double")).alias(f"{c}__o") for c in cols])
    w = Window.partitionBy()  # tiny table: one row per class
    rows = []
    for c in cols:
        exp = F.col("_n") / F.sum("_n").over(w) * F.sum(f"{c}__o").over(w)
        g = g.withColumn(f"{c}__t", F.try_divide(F.pow(F.col(f"{c}__o") - exp, 2), exp))
        rows.append(F.sum(f"{c}__t").alias(c))
    one = g.agg(*rows)
    out = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("score")) for c in cols])).alias("x"))
    return _rank(out.select("x.*"), k)


# ---------------------------------------------------------------- SEL5
def mutual_information(df: DataFrame, cols: Sequence[str], label: str = LABEL, bins: int = 10, k: int | None = None) -> DataFrame:
    """MI (nats) between each feature cut at its deciles (right-closed) and the class, over labelled rows."""
    df = df.where(F.col(label).isNotNull())
    qs = [i / bins for i in range(1, bins)]
    edges = fit_quantiles(df, cols, qs)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), bin_of(F.col(c).cast("double"), edges[c]).alias("b"))
                                for c in cols]))
    j = (df.select(F.col(label).alias("y"), cells.alias("_c")).select("y", "_c.*").where("b IS NOT NULL")
           .groupBy("feature", "b", "y").agg(F.count(F.lit(1)).alias("n")))
    of = Window.partitionBy  # at most features x bins x classes rows
    total = F.sum("n").over(of("feature"))
    term = (F.col("n") / total) * F.log(F.col("n") * total / (F.sum("n").over(of("feature", "b")) * F.sum("n").over(of("feature", "y"))))
    t = j.withColumn("t", term)
    one = t.agg(*[F.sum(F.when(F.col("feature") == c, F.col("t"))).alias(f"s{i}") for i, c in enumerate(cols)])
    res = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("score"))
                                         for i, c in enumerate(cols)])).alias("x")).select("x.*")
    return _rank(res, k)


def digamma(n: Column) -> Column:
    """The digamma function of whole numbers from 1 on: six steps of its recurrence, then its series (error below 1e-12)."""
    x = n.cast("double") + 6
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6) + 1 / (240 * x ** 8)
    return series - sum((1 / (n.cast("double") + i) for i in range(1, 6)), 1 / n.cast("double"))


def neighbour_mutual_information(df: DataFrame, cols: Sequence[str], key: str, label: str = LABEL, neighbours: int = 3,
                                 k: int | None = None, block: int = 4096) -> DataFrame:
    """MI (nats) between each feature and the class from nearest neighbours, without bins, over labelled rows.

    For every row, d is the distance to its ``neighbours``-th nearest row of the same class (fewer in a smaller class;
    classes of one row are left out) and m the rows of any class nearer than d (or equal, where d is 0), itself included;
    MI = psi(N) + mean psi(neighbours) - mean psi(class size) - mean psi(m), at least 0. The estimate does not depend
    on the feature's scale. Equal values are told apart, as the estimator needs, by a noise of 1e-10 of the feature's size
    from the hash of ``key``.

    A class's values are put in order over range partitions; a value's nearest lie within
    ``neighbours`` places of it, so windows over blocks of ``block`` places with so many places copied from the blocks
    beside them find d. m is a difference of running counts at the two ends of the distance.
    """
    means = df.where(F.col(label).isNotNull()).agg(*[F.avg(F.abs(F.col(f"`{c}`").cast("double"))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    cells = []
    for i, c in enumerate(cols):
        mean = means[f"m{i}"]
        size = 2.0 ** math.ceil(math.log2(max(1.0, mean))) if mean is not None and math.isfinite(mean) else 1.0
        draw = unit_hash(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(c)) - 0.5
        cells.append(F.struct(F.lit(c).alias("feature"), (F.col(f"`{c}`").cast("double") + draw * F.lit(2e-10 * size)).alias("x")))
    v = df.where(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.explode(F.array(*cells)).alias("_c")).select(
        "_c.feature", "y", "_c.x").where("x IS NOT NULL AND NOT isnan(x)").groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    v = written(v, "mi-values")
    sizes = v.groupBy("feature", "y").agg(F.sum("n").alias("ny")).where("ny > 1")  # one row per feature and class
    v = v.join(sizes, ["feature", "y"])
    placed = places_in_order(v, ["feature", "y"], ["x"], "p")
    spots = F.array_distinct(F.array(*[F.expr(f"greatest(p + {o}, 0L) div {block}") for o in (-neighbours, 0, neighbours)]))
    spread = placed.withColumn("b", F.explode(spots))
    near = Window.partitionBy("feature", "y", "b").orderBy("x").rowsBetween(-neighbours, neighbours)
    around = spread.withColumn("w", F.collect_list(F.struct("x", "n")).over(near)).where(F.col("b") == F.expr(f"p div {block}"))
    kk = F.least(F.lit(neighbours), F.col("ny") - 1)
    by_distance = F.sort_array(F.transform("w", lambda e: F.struct(
        F.abs(e["x"] - F.col("x")).alias("d"), e["x"].alias("v"), F.when(e["x"] == F.col("x"), e["n"] - 1).otherwise(e["n"]).alias("n"))))
    start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("d"), F.col("x").alias("v"))
    kth = F.aggregate(by_distance, start, lambda a, e: F.when((a["c"] >= kk) | (e["n"] == 0), a).otherwise(
        F.struct((a["c"] + e["n"]).alias("c"), e["d"].alias("d"), e["v"].alias("v"))))
    d = around.select("feature", "y", "x", "n", "ny", kk.alias("kk"), kth.alias("k")).select(
        "feature", "y", "x", "n", "ny", "kk", F.col("k.d").alias("d"),
        F.when(F.col("k.v") > F.col("x"), F.col("k.v")).otherwise(F.col("x") + F.col("k.d")).alias("top"),
        F.when(F.col("k.v") < F.col("x"), F.col("k.v")).otherwise(F.col("x") - F.col("k.d")).alias("low"))
    # counts of rows nearer than d: running counts just before one end and just after the other (at x itself where d is 0)
    points = v.select("feature", F.col("x").alias("at"), F.lit(1).alias("kind"), F.col("n").alias("c"),
                      *[F.lit(None).cast(t).alias(c) for c, t in (("y", v.schema["y"].dataType), ("x", "double"), ("n", "long"), ("ny", "long"), ("kk", "long"))],
                      F.lit(None).cast("boolean").alias("upper"))
    ends = d.select("feature", F.explode(F.array(
        F.struct(F.col("top").alias("at"), F.when(F.col("d") > 0, 0).otherwise(2).alias("kind"), F.lit(True).alias("upper")),
        F.struct(F.col("low").alias("at"), F.when(F.col("d") > 0, 2).otherwise(0).alias("kind"), F.lit(False).alias("upper")))).alias("e"),
        "y", "x", "n", "ny", "kk").select("feature", "e.at", "e.kind", F.lit(0).cast("long").alias("c"), "y", "x", "n", "ny",
                                          F.col("kk").cast("long").alias("kk"), "e.upper")
    counted = running_total(points.unionByName(ends), ["feature"], ["at", "kind"], "c", "below").where("upper IS NOT NULL")
    m = counted.groupBy("feature", "y", "x", "n", "ny", "kk").agg(
        (F.max(F.when(F.col("upper"), F.col("below"))) - F.max(F.when(~F.col("upper"), F.col("below")))).alias("m"))
    total = m.groupBy("feature").agg(F.sum("n").alias("N"), F.sum(
        F.col("n") * (digamma(F.col("kk")) - digamma(F.col("ny")) - digamma(F.col("m")))).alias("s"))
    score = total.select("feature", F.greatest(digamma(F.col("N")) + F.col("s") / F.col("N"), F.lit(0.0)).alias("score"))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return _rank(attach_stats(every, score, ["feature"]), k)
