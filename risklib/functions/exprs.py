"""Column-expression helpers shared by the operators.

All helpers return native Catalyst expressions (whole-stage codegen, no
Python at run time).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cut(x, edges: Sequence[float], labels: Sequence, include_lowest: bool = False) -> Column:
    """Right-closed binning as ``pandas.cut``: bin i is (e[i], e[i+1]].

    With ``include_lowest`` the first bin is [e[0], e[1]]. Values outside
    the edges (and null) give null. ``edges`` may be Columns (data-dependent
    edges from a scalar subquery).
    """
    x = _c(x)
    lo = F.lit(edges[0]) if not isinstance(edges[0], Column) else edges[0]
    expr = None
    for i, lab in enumerate(labels):
        e_hi = edges[i + 1]
        hi = e_hi if isinstance(e_hi, Column) else (None if e_hi == math.inf else F.lit(e_hi))
        upper = (x <= hi) if hi is not None else F.lit(True)
        cond = upper if i > 0 else (((x >= lo) if include_lowest else (x > lo)) & upper)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    lower_ok = (x >= lo) if include_lowest else (x > lo)
    return F.when(x.isNotNull() & lower_ok, expr)


def flag(cond: Column) -> Column:
    """0/1 INT flag; a null comparison counts as False (as NaN comparisons do in pandas)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def safe_div(a, b) -> Column:
    """a / b, null when b is 0 or null (ANSI mode raises on x/0)."""
    return F.try_divide(_c(a), _c(b))


def r6(x) -> Column:
    return F.round(_c(x), 6)


def micros(ts) -> Column:
    return F.unix_micros(_c(ts))


def weekday(ts) -> Column:
    """Monday = 0 ... Sunday = 6 (pandas ``dayofweek``)."""
    return F.weekday(_c(ts))


# Fixed label sets of the period-of-day variants.
PERIOD_LABELS_EN = ["early_morning", "morning", "afternoon", "evening"]
PERIOD_LABELS_PT = ["madrugada", "manha", "tarde", "noite"]


def period_of_day_a(hour, labels: Sequence[str] = PERIOD_LABELS_EN) -> Column:
    """Variant A: cut(hour, [0, 6, 12, 18, 24], include_lowest) -> 0-6 / 7-12 / 13-18 / 19-23."""
    return cut(hour, [0, 6, 12, 18, 24], labels, include_lowest=True)


def period_of_day_b(hour) -> Column:
    """Variant B: <6 early_morning, <12 morning, <18 afternoon, else (null too) night."""
    h = _c(hour)
    return (F.when(h < 6, "early_morning").when(h < 12, "morning").when(h < 18, "afternoon")
            .otherwise("night"))


def cyclic_distance(a, b, period: float = 24.0) -> Column:
    d = F.abs(_c(a) - _c(b))
    return F.least(d, F.lit(period) - d)
