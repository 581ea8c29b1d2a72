"""Helpers for registered queries: rounding doubles so both engines hash the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE/FLOAT column (sum order differs between engines in the last bits)."""
    out = []
    for name, t in df.dtypes:
        if t in ("double", "float"):
            out.append(F.round(F.col(name).cast("double"), digits).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def r6(*cols: str) -> str:
    """SQL select list rounding the given double columns to 6 dp."""
    return ", ".join(f"ROUND({c}, 6) AS {c.split('.')[-1]}" for c in cols)
