"""Distinct counts of any period from mergeable sketches kept per day, exact below a size limit.

A day's column is summed up once as a sketch (HyperLogLog, ``LG_K`` bits of registers,
standard error 1.04 / 2**(LG_K / 2)); days with at most ``limit`` distinct values also keep the
values. A period's count is exact when all its days kept theirs and together hold no more than
``limit``; otherwise the days' sketches are merged. The rows are read once per day and never again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklib.operators.keyed import attach_stats, written
from risklib.schema import TS

LG_K, LIMIT = 14, 10_000


def daily_distinct(df: DataFrame, cols: Sequence[str], ts: str = TS, limit: int = LIMIT, lg_k: int = LG_K) -> DataFrame:
    """(day, column, sketch, members): one row per day and column with a value; ``members`` are the day's distinct values as
    text, or null beyond ``limit``. Rows without a time are the null day; nulls are not counted."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols]))
    long = df.select(F.to_date(ts).alias("day"), cells.alias("_c")).select("day", "_c.column", "_c.v").where("v IS NOT NULL")
    days = written(long.groupBy("day", "column").agg(F.hll_sketch_agg("v", F.lit(lg_k)).alias("sketch")), "daily-sketches")
    # the sketch tells which days are small enough to keep; its error is a few percent at most
    small = days.where(F.hll_sketch_estimate("sketch") <= 1.1 * limit).select("day", "column", F.lit(True).alias("_small"))
    kept = attach_stats(long, small, ["day", "column"], null_safe=True).where("_small").groupBy("day", "column", "v").agg(F.lit(1))
    members = kept.groupBy("day", "column").agg(F.sort_array(F.collect_list("v")).alias("members")).where(F.size("members") <= limit)
    return attach_stats(days, members, ["day", "column"], null_safe=True)


def distinct_counts(daily: DataFrame, period: Column, limit: int = LIMIT) -> DataFrame:
    """(period, column, n_distinct, exact) of every period of days (a column over ``day``)."""
    rows = daily.withColumn("period", period)
    both = rows.groupBy("period", "column").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("_estimate"), F.bool_and(F.col("members").isNotNull()).alias("_all"))
    values = rows.where("members IS NOT NULL").select("period", "column", F.explode("members").alias("v"))
    exact = values.groupBy("period", "column", "v").agg(F.lit(1)).groupBy("period", "column").agg(F.count(F.lit(1)).alias("_n"))
    out = attach_stats(both, exact, ["period", "column"], null_safe=True)
    known = F.col("_all") & (F.col("_n") <= limit)
    return out.select("period", "column", F.when(known, F.col("_n")).otherwise(F.col("_estimate")).cast("long").alias("n_distinct"),
                      F.coalesce(known, F.lit(False)).cast("int").alias("exact"))
