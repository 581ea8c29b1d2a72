"""Encoding, scaling, splitting and class balancing (ENC1-4, SCA1, SPL1-2, BAL3-5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from risklib.operators.keyed import attach_stats, hash_rank, places_in_order
from risklib.schema import LABEL, numeric_columns, string_columns


MAX_ONE_HOT_LEVELS = 1000


# ---------------------------------------------------------------- ENC1
def label_encode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Lexicographic integer codes; null is the string 'nan' (as astype(str) gives).

    The vocabulary (distinct values) is ranked by range partitions (``places_in_order``), so ids that
    share a long prefix are spread like any other values.
    """
    cols = list(cols or string_columns(df))
    for c in cols:
        v = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        vocab = places_in_order(df.select(v.alias("_v")).distinct(), [], ["_v"], "_code").select("_v", F.col("_code").cast("int"))
        df = df.withColumn("_v", v).join(vocab, "_v", "left").drop("_v", c).withColumnRenamed("_code", c)
    return df


# ---------------------------------------------------------------- ENC2
def one_hot(df: DataFrame, col: str, values: Sequence | None = None, drop: bool = True,
            max_levels: int = MAX_ONE_HOT_LEVELS) -> DataFrame:
    """One 0/1 column per level (``col_value``); unseen levels give all zeros.

    ``values`` fixes the levels at plan time (fit on train, apply anywhere);
    when absent they are fitted. A column of more than ``max_levels`` levels raises (label or target encode it instead):
    at most ``max_levels + 1`` values reach the driver, and no plan gets a column per id.
    """
    if values is None:
        values = sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_levels + 1).collect())
        if len(values) > max_levels:
            raise ValueError(f"{col} has more than {max_levels} levels; use label or target encoding")
    out = df
    for v in values:
        out = out.withColumn(f"{col}_{v}", F.coalesce((F.col(col) == F.lit(v)).cast("double"), F.lit(0.0)))
    return out.drop(col) if drop else out


# ---------------------------------------------------------------- ENC3/ENC4
def target_encode_oof(df: DataFrame, col: str, fold_col: str = "fold", label: str = LABEL,
                      smoothing: float = 10.0, out: str | None = None) -> DataFrame:
    """Out-of-fold mean of the label per level: statistics of the other folds only, smoothed
    towards the global rate with weight ``smoothing``. Levels unseen outside the fold get the prior."""
    out = out or f"{col}_te"
    prior = F.lit(df.agg(F.avg(F.col(label).cast("double"))).first()[0]).cast("double")
    per = df.groupBy(col, fold_col).agg(F.sum(label).alias("_sf"), F.count(label).alias("_nf"))
    tot = per.groupBy(col).agg(F.sum("_sf").alias("_sa"), F.sum("_nf").alias("_na"))
    st = per.join(tot, col)
    s = F.col("_sa") - F.col("_sf")
    n = F.col("_na") - F.col("_nf")
    st = st.select(col, fold_col, ((s + F.lit(smoothing) * prior) / (n + F.lit(smoothing))).alias(out))
    return df.join(st, [col, fold_col], "left").withColumn(out, F.coalesce(F.col(out), prior))


# ---------------------------------------------------------------- SCA1
def standard_scale(df: DataFrame, cols: Sequence[str] | None = None, target: str = LABEL) -> DataFrame:
    """z = (x - mean) / population sd (sd 0 -> divisor 1), all statistics from one aggregate."""
    cols = [c for c in (cols or numeric_columns(df)) if c != target]
    st = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    sel = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c)
            sd = st[f"s{i}"] if st[f"s{i}"] else 1.0
            sel.append(((F.col(c) - F.lit(st[f"m{i}"])) / F.lit(sd)).alias(c))
        else:
            sel.append(F.col(c))
    return df.select(*sel)


# ---------------------------------------------------------------- SPL1/SPL2
def stratified_split(df: DataFrame, key: str, label: str = LABEL, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: per class, the first round(n_c * test_size) rows by md5(key || seed).

    Rows without a label belong to no class: they are kept, with a null ``is_test``.
    """
    r = hash_rank(df, [label], key, seed)
    n = r.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # a join dealt by the class would put a class's rows in one task, here and in all that follows
    r = attach_stats(r, F.broadcast(n), [label], null_safe=True)
    ntest = F.round(F.col("_n") * F.lit(test_size)).cast("long")
    is_test = F.when(F.col(label).isNotNull(), (F.col("hash_rank") < ntest).cast("int"))
    return r.withColumn("is_test", is_test).drop("_n", "hash_rank")


def kfold(df: DataFrame, key: str, k: int = 5, label: str | None = LABEL, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in [0, k): rank by md5 within the class (stratified) modulo k; null without a label."""
    r = hash_rank(df, [label] if label else [], key, seed)
    fold = (F.col("hash_rank") % k).cast("int")
    return r.withColumn("fold", F.when(F.col(label).isNotNull(), fold) if label else fold).drop("hash_rank")


# ---------------------------------------------------------------- BAL3/BAL4/BAL5
def _class_counts(df: DataFrame, label: str):
    c = df.agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")).first()
    pos, neg = c["pos"] or 0, c["neg"] or 0
    return 1 if pos <= neg else 0, min(pos, neg), max(pos, neg)


def random_oversample(df: DataFrame, key: str, label: str = LABEL, seed: int = 42) -> DataFrame:
    """Minority rows repeated to exact parity: floor(n_maj / n_min) full copies plus the
    first (n_maj mod n_min) rows by hash. Adds ``copy`` (0 = original row). Rows without a
    label are kept once; with one class only there is nothing to repeat."""
    minority, n_min, n_maj = _class_counts(df, label)
    if n_min == 0:
        return df.withColumn("copy", F.lit(0))
    reps, rem = n_maj // n_min, n_maj % n_min
    r = hash_rank(df.where(F.col(label) == minority), [], key, seed)
    copies = F.when(F.col("hash_rank") < rem, F.lit(reps)).otherwise(F.lit(reps - 1))
    mino = r.withColumn("copy", F.explode(F.sequence(F.lit(0), copies))).drop("hash_rank")
    rest = df.where(~F.col(label).eqNullSafe(F.lit(minority))).withColumn("copy", F.lit(0))
    return rest.unionByName(mino)


def random_undersample(df: DataFrame, key: str, label: str = LABEL, seed: int = 42) -> DataFrame:
    """Majority rows with hash rank < n_min (exact parity), all minority rows and all rows without a label."""
    minority, n_min, _ = _class_counts(df, label)
    r = hash_rank(df.where(F.col(label) != minority), [], key, seed)
    rest = df.where(F.col(label).isNull() | (F.col(label) == minority))
    return rest.unionByName(r.where(F.col("hash_rank") < n_min).drop("hash_rank"))


def class_weights(df: DataFrame, label: str = LABEL, out: str = "weight") -> DataFrame:
    """'balanced' weights n / (2 * n_c) as a column (for ``weightCol``), n the labelled rows; null without a label."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    n = n.withColumn("_w", F.sum("_nc").over(Window.partitionBy()) / (F.lit(2.0) * F.col("_nc")))  # one row per class
    return attach_stats(df, F.broadcast(n.select(label, F.col("_w").alias(out))), [label])
