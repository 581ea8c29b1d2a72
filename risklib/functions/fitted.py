"""Fitted parameters: one aggregate pass returning ONE row, bound into later plans as literals.

This is the ``fit`` half of an estimator: the statistic is computed once
(an O(1)-size result reaches the driver, never row data), and every later
expression that uses it is a literal. Referencing a scalar subquery many
times instead would re-run the aggregate (a full scan) per reference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def fit_row(df: DataFrame, *aggs: Column) -> Row:
    return df.agg(*aggs).first()


def most_frequent(df: DataFrame, cols: Sequence[str]) -> dict:
    """The most frequent non-null value of every string column (ties -> smallest; null if there is none).

    Values are counted in one grouped pass over all columns, combined before
    the shuffle, so no buffer holds a column's distinct values; one value per
    column reaches the driver.
    """
    if not cols:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(cols)]))
    counts = df.select(cells.alias("c")).select("c.i", "c.v").where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("i").agg(F.min_by("v", F.struct(F.negative("n"), "v")).alias("v")).collect()
    return dict.fromkeys(cols) | {cols[r["i"]]: r["v"] for r in top}


def lit(v, dtype: str = "double") -> Column:
    return F.lit(v).cast(dtype)
