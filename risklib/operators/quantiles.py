"""Exact quantiles of many columns (and groups) without a buffer per column.

``percentile`` and ``median`` keep every distinct value of a column in one
aggregation buffer. Here equal values are counted first (combined before the
shuffle), each (column, group) is cut into parts of bounded size, and running
counts inside the parts plus the totals of earlier parts give every value its
ranks. The values at the wanted ranks are then picked by a plain aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklib.operators.keyed import ROWS_PER_PART, attach_stats, cut_by_volume


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                   rows_per_part: int = ROWS_PER_PART, weight: str | None = None) -> DataFrame:
    """(column, *by, q): ``q`` holds the linearly interpolated quantiles of the non-null values, in the
    order of ``probs``. A column without values in a group has no row there. With ``weight`` a row stands
    for so many equal rows."""
    by, keys = list(by), ["column", *by]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols]))
    n = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    counts = (df.select(*by, n.alias("_n"), cells.alias("_c")).select(*by, "_n", "_c.column", "_c.v").where("v IS NOT NULL AND _n > 0")
                .groupBy(*keys, "v").agg(F.sum("_n").alias("_n")))
    c = cut_by_volume(counts, keys, "v", rows_per_part)
    parts = c.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    of_key = Window.partitionBy(*keys)  # one row per part
    parts = parts.select(*keys, "_b", F.sum("_bn").over(of_key).alias("_all"), (F.sum("_bn").over(
        of_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bn")).alias("_before"))
    up_to = F.col("_before") + F.sum("_n").over(
        Window.partitionBy(*keys, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    r = attach_stats(c, parts, [*keys, "_b"], null_safe=True).withColumn("_end", up_to)

    def at(rank):  # the value that holds a 0-based rank
        return F.max(F.when((rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end")), F.col("v")))

    aggs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("_all") - 1)
        aggs += [at(F.floor(pos)).alias(f"_lo{i}"), at(F.ceil(pos)).alias(f"_hi{i}"),
                 F.max(pos - F.floor(pos)).alias(f"_f{i}")]
    q = [F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}")).otherwise(
        F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")) for i in range(len(probs))]
    return r.groupBy(*keys).agg(*aggs).select(*keys, F.array(*q).alias("q"))


def fit_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list | None]:
    """The quantiles of every column as numbers (``len(cols) * len(probs)`` of them reach the driver);
    None for a column without values."""
    found = {r["column"]: list(r["q"]) for r in quantile_table(df, cols, probs).collect()} if cols else {}
    return {c: found.get(c) for c in cols}


def bin_of(x: Column, edges: Sequence[float] | None) -> Column:
    """Number of edges below ``x`` (right-closed bins); null for a null ``x`` or without edges."""
    if edges is None:
        return F.lit(None).cast("int")
    return F.when(x.isNotNull(), sum(F.when(x > F.lit(e), 1).otherwise(0) for e in edges))


def weighted_quantiles(groups: DataFrame, col: str, weight: str, probs: Sequence[float], most: int = 1_000_000) -> list[float] | None:
    """Row-weighted quantiles of a per-group number. Up to ``most`` groups meet in one aggregate buffer;
    beyond, the same numbers come from bounded parts. None without values."""
    if groups.limit(most + 1).count() <= most:
        row = groups.agg(F.percentile(col, F.array(*[F.lit(p) for p in probs]), F.col(weight)).alias("q")).first()
    else:
        row = quantile_table(groups, [col], probs, weight=weight).first()
    return list(row["q"]) if row and row["q"] is not None else None
