"""Exploration and monitoring aggregates (AGG12-AGG31, TOP1-4, SET1, SMP1, FLT1-3).

Every operator is a grouped aggregate (partial aggregation before the
shuffle); windows without a partition key only run on small aggregated
tables whose size is bounded by the number of groups (days, hours, bins).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklib.functions.exprs import safe_div, weekday
from risklib.functions.fitted import fit_row, lit
from risklib.operators.keyed import attach_stats
from risklib.operators.quantiles import quantile_table
from risklib.schema import AMOUNT, LABEL, TS, numeric_columns

# Day names in weekday order (Monday = 0).
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _stack(cols: Sequence[str], name_col: str, value_col: str, value_type: str = "double") -> str:
    return "stack({}, {}) as ({}, {})".format(
        len(cols), ", ".join(f"'{c}', CAST(`{c}` AS {value_type})" for c in cols), name_col, value_col)


# ---------------------------------------------------------------- AGG12
def describe(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """count / mean / std (sample) / min / 25% / 50% / 75% / max per numeric column, long form."""
    cols = list(cols or numeric_columns(df))
    probs = [0.25, 0.5, 0.75]
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        st = [F.count(x).cast("double").alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
              F.min(x).alias("min"), F.max(x).alias("max")]
        if not exact:
            st.append(F.percentile_approx(x, F.array(*[F.lit(p) for p in probs]), 100000).alias("q"))
        aggs.append(F.struct(*st).alias(c))
    one = df.agg(*aggs)
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in cols])).alias("r"))
    s = long.select("r.column", "r.s.*")
    if exact:
        s = s.join(quantile_table(df, cols, probs), "column", "left")
    stats = {"count": F.col("count"), "mean": F.col("mean"), "std": F.col("std"), "min": F.col("min"),
             "25%": F.col("q")[0], "50%": F.col("q")[1], "75%": F.col("q")[2], "max": F.col("max")}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), v.alias("value")) for k, v in stats.items()]))
    return s.select("column", rows.alias("x")).select("column", "x.stat", "x.value")


# ---------------------------------------------------------------- AGG13
def class_distribution(df: DataFrame, label: str = LABEL) -> DataFrame:
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = df.select(F.count(F.lit(1))).scalar()
    return c.withColumn("share", F.col("count") / total)


# ---------------------------------------------------------------- AGG14/AGG15/AGG19
def label_crosstab(df: DataFrame, by, label: str = LABEL) -> DataFrame:
    """rows of ``by`` x columns legit/fraud counts (explicit pivot values, zero-filled)."""
    by = [by] if isinstance(by, str) else list(by)
    p = df.groupBy(*by).pivot(label, [0, 1]).agg(F.count(F.lit(1)))
    return p.select(*by, F.coalesce(F.col("0"), F.lit(0)).cast("long").alias("legit"),
                    F.coalesce(F.col("1"), F.lit(0)).cast("long").alias("fraud"))


def hour_by_label(df: DataFrame) -> DataFrame:
    return label_crosstab(df.withColumn("hour", F.hour(TS)), "hour")


def dayname_by_label(df: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(n) for n in DAY_NAMES])
    d = df.withColumn("weekday", weekday(TS))
    out = label_crosstab(d, "weekday")
    return out.withColumn("day_name", F.element_at(names, F.col("weekday") + 1)).orderBy("weekday")


# ---------------------------------------------------------------- AGG16/AGG26
def trend(df: DataFrame, freq: str = "daily", label: str = LABEL) -> DataFrame:
    """Totals per day / week (labelled by the Sunday ending it) / month (labelled by month end).

    Empty periods appear with zero counts: the period list is generated from
    the min and max period (one small row) and left-joined to the counts.
    """
    d = F.to_date(TS)
    if freq == "daily":
        per = d
        step = "1 day"
    elif freq == "weekly":
        per = F.date_add(F.to_date(F.date_trunc("week", TS)), 6)
        step = "7 days"
    elif freq == "monthly":
        per = F.last_day(d)
        step = None
    else:
        raise ValueError(freq)
    g = (df.where(F.col(TS).isNotNull()).groupBy(per.alias("period"))
           .agg(F.count(F.lit(1)).alias("total"), F.sum(label).cast("long").alias("fraud")))
    bounds = g.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    if step:
        seq = F.sequence("lo", "hi", F.expr(f"INTERVAL {step}"))
        periods = bounds.select(F.explode(seq).alias("period"))
    else:
        seq = F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("INTERVAL 1 MONTH"))
        periods = bounds.select(F.explode(seq).alias("m")).select(F.last_day("m").alias("period"))
    out = periods.join(g, "period", "left").select(
        "period", F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        F.coalesce("fraud", F.lit(0)).cast("long").alias("fraud"))
    return out.withColumn("fraud_rate", F.coalesce(safe_div("fraud", "total"), F.lit(0.0)))


# ---------------------------------------------------------------- AGG17/FLT2/TOP1/TOP2
def group_fraud(df: DataFrame, by, min_count: int = 5, label: str = LABEL) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.sum(label).cast("long").alias("fraud"))
    return g.where(F.col("total") >= min_count).withColumn("fraud_rate", F.col("fraud") / F.col("total"))


def top_by_volume(df: DataFrame, by: str, n: int = 10) -> DataFrame:
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    return g.orderBy(F.desc("total"), F.asc(by)).limit(n)


def top_by_fraud_rate(df: DataFrame, by: str, n: int = 10, min_count: int = 5) -> DataFrame:
    return group_fraud(df, by, min_count).orderBy(F.desc("fraud_rate"), F.desc("total"), F.asc(by)).limit(n)


# ---------------------------------------------------------------- AGG18
def pair_rate_long(df: DataFrame, row: str, col: str, min_count: int = 3, label: str = LABEL) -> DataFrame:
    """state x city fraud rate for pairs with >= min_count rows (long form of the pivot table)."""
    return group_fraud(df, [row, col], min_count, label).select(row, col, "fraud_rate")


def pair_rate_pivot(df: DataFrame, row: str, col: str, values: Sequence, min_count: int = 3) -> DataFrame:
    """Wide form with explicit pivot values (known at plan time), empty cells 0."""
    long = pair_rate_long(df, row, col, min_count)
    p = long.groupBy(row).pivot(col, list(values)).agg(F.first("fraud_rate"))
    return p.na.fill(0.0)


# ---------------------------------------------------------------- AGG20
def histogram(df: DataFrame, col: str, bins: int = 20, by: str | None = LABEL) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed), counts per bin and class."""
    x = F.col(col).cast("double")
    mm = fit_row(df, F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo, hi = lit(mm["lo"]), lit(mm["hi"])
    w = (hi - lo) / bins
    b = (F.lit(0) if mm["lo"] == mm["hi"] else F.least(F.floor((x - lo) / w), F.lit(bins - 1))).cast("int")
    keys = [b.alias("bin")] + ([F.col(by)] if by else [])
    g = df.where(x.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("bin_lo", lo + F.col("bin") * w).withColumn("bin_hi", lo + (F.col("bin") + 1) * w)


# ---------------------------------------------------------------- AGG21
def box_stats(df: DataFrame, col: str, by: str = LABEL) -> DataFrame:
    x = F.col(col).cast("double")
    q = quantile_table(df, [col], [0.25, 0.5, 0.75], [by])
    q = q.select(by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    j = attach_stats(df.select(by, x.alias("_x")).where("_x IS NOT NULL"), q, [by], null_safe=True)
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    return j.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(F.col("_x") >= lo_f, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(F.col("_x") <= hi_f, F.col("_x"))).alias("whisker_hi"),
        F.count(F.when((F.col("_x") < lo_f) | (F.col("_x") > hi_f), 1)).alias("outliers"))


# ---------------------------------------------------------------- AGG22/AGG23
PAIR_COLUMNS = 50  # columns up to which every pair is one aggregate expression


def pearson(a: Column, b: Column) -> Column:
    """Correlation over the rows with both values; null without rows or variance (``corr`` raises there in ANSI mode)."""
    return F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(F.when(b.isNotNull(), a)) * F.var_pop(F.when(a.isNotNull(), b))))


def correlation_long(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson r for every ordered pair (pairwise-complete rows), one aggregate pass; wide tables go by ``correlation_blocks``."""
    cols = list(cols or numeric_columns(df))
    if len(cols) > PAIR_COLUMNS:
        return correlation_blocks(df, cols)
    aggs = [pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}_{j}")
            for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    one = df.agg(*aggs) if aggs else None
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i < j:
                pairs += [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"{i}_{j}").alias("r")),
                          F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"{i}_{j}").alias("r"))]
    return one.select(F.explode(F.array(*pairs)).alias("p")).select("p.col_a", "p.col_b", "p.r")


def correlation_blocks(df: DataFrame, cols: Sequence[str], block: int = 1024) -> DataFrame:
    """Pearson r for every ordered pair (pairwise-complete rows) of any number of columns, from Gram matrices.

    Every task adds up, for a block of columns against all, the products of its rows' values, squares and presence flags (nulls
    count as 0, their flags as absent): rows, sums, sums of squares and products of the pairs where both are there. The
    tasks' shares are added by column, and r is computed in that column's row. Values are taken about their column mean. A pair
    without rows or without variance has a null r. The plan has one array per column, not one expression per pair.
    """
    cols = list(cols)
    d = len(cols)
    xs = [F.col(f"`{c}`").cast("double") for c in cols]
    one = df.agg(F.array(*[F.avg(F.when(~F.isnan(x), x)) for x in xs]).alias("m")).first()
    mean = np.array([0.0 if m is None else m for m in one["m"]])
    names = pa.array(cols)
    rows = df.select(F.array(*xs).alias("x"))
    out = None
    for at in range(0, d, block):
        mine = np.arange(at, min(at + block, d))

        def share(batches, mine=mine):
            total = np.zeros((6, len(mine), d))
            for b in batches:
                x = np.asarray(b.column(0).flatten().fill_null(np.nan)).reshape(-1, d)
                there = (~np.isnan(x)).astype(float)
                v = np.where(np.isnan(x), 0.0, x - mean)
                v2 = v * v
                a, a2, ta = v[:, mine], v2[:, mine], there[:, mine]
                for i, (l, r) in enumerate(((ta, there), (a, there), (ta, v), (a2, there), (ta, v2), (a, v))):
                    total[i] += l.T @ r
            yield pa.record_batch({"a": pa.array(mine.astype(np.int64)), "t": pa.array(
                list(total.transpose(1, 0, 2).reshape(len(mine), -1)), pa.list_(pa.float64()))})

        def add(key, table):
            shares = np.asarray(table.column("t").combine_chunks().flatten()).reshape(-1, 6 * d)
            n, sa, sb, qa, qb, ab = shares[np.lexsort(shares.T[::-1])].sum(axis=0).reshape(6, d)
            with np.errstate(all="ignore"):
                va, vb = qa - sa * sa / n, qb - sb * sb / n
                r = (ab - sa * sb / n) / np.sqrt(va * vb)
            # what rounding leaves of a constant column is no variance
            r[~((va > 1e-13 * qa) & (vb > 1e-13 * qb))] = np.nan
            i = key[0].as_py()
            other = np.arange(d) != i
            return pa.table({"col_a": names.take(pa.array(np.full(d - 1, i))), "col_b": names.filter(pa.array(other)),
                             "r": pa.array(r[other], from_pandas=True)})

        part = rows.mapInArrow(share, "a long, t array<double>").groupBy("a").applyInArrow(add, "col_a string, col_b string, r double")
        out = part if out is None else out.unionByName(part)
    return out


def target_correlation(df: DataFrame, target: str = LABEL, cols: Sequence[str] | None = None, top: int | None = None) -> DataFrame:
    cols = [c for c in (cols or numeric_columns(df)) if c != target]
    one = df.agg(*[pearson(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    long = one.select(F.expr(_stack(cols, "feature", "r")))
    ranked = long.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc_nulls_last(F.abs("r")), F.asc("feature"))))
    return ranked.where(F.col("rank") <= top) if top else ranked


# ---------------------------------------------------------------- AGG25/AGG27/AGG28
def kpis(df: DataFrame, label: str = LABEL, latency: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("total_transactions"), F.sum(label).cast("long").alias("fraud_count"),
            (F.avg(label) * 100).alias("fraud_pct"), F.avg(AMOUNT).alias("avg_amount")]
    if latency:
        aggs.append(F.avg(latency).alias("avg_latency"))
    return df.agg(*aggs)


def kpi_deltas(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Daily KPIs with absolute and relative change against the previous day (small daily table)."""
    t = trend(df, "daily", label).withColumn("fraud_pct", F.col("fraud_rate") * 100)
    w = Window.orderBy("period")
    out = t
    for c in ("total", "fraud", "fraud_pct"):
        prev = F.lag(c).over(w)
        # deltas are doubles (null for the first day), as a pandas diff() gives
        out = (out.withColumn(f"{c}_delta", (F.col(c) - prev).cast("double"))
                  .withColumn(f"{c}_change", safe_div(F.col(c) - prev, prev)))
    return out


def shares(df: DataFrame, by: str) -> DataFrame:
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("count"))
    total = df.select(F.count(F.lit(1))).scalar()
    return g.withColumn("share", F.col("count") / total)


# ---------------------------------------------------------------- AGG30
def pattern_detection(df: DataFrame, flags: Sequence[str], label: str = LABEL) -> DataFrame:
    """Per flag: flagged rows, detection rate (TP / positives), false-positive rate (FP / negatives)."""
    aggs = [F.sum(F.col(label)).alias("_pos"), F.sum(1 - F.col(label)).alias("_neg")]
    for f in flags:
        aggs += [F.sum(F.col(f)).alias(f"{f}__n"), F.sum(F.col(f) * F.col(label)).alias(f"{f}__tp"),
                 F.sum(F.col(f) * (1 - F.col(label))).alias(f"{f}__fp")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("pattern"), F.col(f"{f}__n").alias("flagged"),
                                        F.col(f"{f}__tp").alias("tp"), F.col(f"{f}__fp").alias("fp"))
                               for f in flags])).alias("x")
    out = one.select("_pos", "_neg", rows)
    return out.select("x.pattern", F.col("x.flagged").cast("long").alias("flagged"),
                      F.coalesce(safe_div("x.tp", "_pos"), F.lit(0.0)).alias("detection_rate"),
                      F.coalesce(safe_div("x.fp", "_neg"), F.lit(0.0)).alias("false_positive_rate"))


# ---------------------------------------------------------------- AGG31
def hotspots(df: DataFrame, city: str, state: str, label: str = LABEL) -> DataFrame:
    g = df.groupBy(city, state).agg(F.count(F.lit(1)).alias("total"), F.sum(label).cast("long").alias("fraud"))
    return g.withColumn("rank", F.dense_rank().over(Window.orderBy(F.desc("fraud"))))


# ---------------------------------------------------------------- FLT3
def look_back(df: DataFrame, period: str = "7 days", anchor=None) -> DataFrame:
    """Rows in (anchor - period, anchor]; anchor defaults to max(event time) (scalar subquery)."""
    a = anchor if anchor is not None else F.lit(fit_row(df, F.max(TS))[0])
    return df.where((F.col(TS) > a - F.expr(f"INTERVAL {period}")) & (F.col(TS) <= a))


# ---------------------------------------------------------------- SMP1
def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Deterministic sample: keep rows whose md5(key || seed) falls under the fraction."""
    u = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return df.where(u < F.lit(int(fraction * (1 << 32))))


# ---------------------------------------------------------------- AGG24
def customer_history(df: DataFrame, key: str = "card_number", ts: str = TS, id_col: str = "transaction_id",
                     value: str = AMOUNT, bucket_hours: int = 168, rows_per_part: int | None = None) -> DataFrame:
    """Mean of the card's earlier amounts, ratio of the amount to it, days per earlier transaction."""
    from risklib.operators.keyed import ROWS_PER_PART, running_history
    h = running_history(df, [key], ts, id_col, value, bucket_hours, rows_per_part or ROWS_PER_PART)
    mean = safe_div(F.col("prior_sum_cents").cast("double") / F.lit(100.0), F.col("prior_values"))
    days = (F.col("_us") - F.col("first_us")) / F.lit(86_400_000_000.0)
    return (h.withColumn("history_mean_amount", mean)
             .withColumn("amount_to_history_ratio", safe_div(F.col(value), F.col("history_mean_amount")))
             .withColumn("days_per_transaction", safe_div(days, F.col("prior_count")))
             .drop("_us", "first_us", "prior_sum_cents", "prior_values"))


# ---------------------------------------------------------------- SCL18
# Keyword rules of the two feature-catalogue views.
FEATURE_KEYWORDS_APP = {
    "Temporal": ["time", "hour", "day", "week", "month", "period"],
    "Amount": ["amount", "value"],
    "Location": ["city", "state", "location"],
    "Behavior": ["customer", "behavior", "transaction"],
    "Fraud Patterns": ["risk", "fraud", "unusual"],
}
FEATURE_KEYWORDS_PAGE = {
    "Temporal": ["time", "hour", "day", "date"],
    "Value": ["amount", "value", "price"],
    "Location": ["location", "city", "country", "merchant"],
}


def tag_features(catalogue: DataFrame, name_col: str = "feature", rules: dict | None = None,
                 lowercase: bool = False, other: str | None = None) -> DataFrame:
    """One row per (feature, category) whose keyword occurs in the name (substring match);
    features matching no rule get ``other`` when given."""
    rules = rules or FEATURE_KEYWORDS_APP
    name = F.lower(F.col(name_col)) if lowercase else F.col(name_col)
    cats = F.array(*[F.when(F.exists(F.array(*[F.lit(k) for k in kws]), lambda k: name.contains(k)), F.lit(c))
                     for c, kws in rules.items()])
    tagged = catalogue.withColumn("_cats", F.filter(cats, lambda c: c.isNotNull()))
    if other is not None:
        tagged = tagged.withColumn("_cats", F.when(F.size("_cats") == 0, F.array(F.lit(other))).otherwise(F.col("_cats")))
    return tagged.select(F.col(name_col), F.explode("_cats").alias("category"))
