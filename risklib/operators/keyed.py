"""Keyed building blocks shared by the feature operators.

Two plan shapes, both safe when one key holds a large share of the rows:

* ``group_stats`` / ``attach_stats``: a grouped aggregate (partial
  aggregation before the shuffle, so a hot key is one row) joined back on
  the key. AQE turns the join into a broadcast when the aggregate is small
  at run time and splits a hot key's partition (skew join) otherwise.

* ``sequence_stage``: per-row "previous row" and time-range counts. A plain
  ``Window.partitionBy(card)`` would put a hot card in one task, so rows
  are partitioned by (key, time bucket). Rows that fall within the longest
  look-back before a bucket's start are copied into that bucket as context
  rows, so range counts stay exact; the previous row of a bucket's first
  row comes from the last row of the previous non-empty bucket (a small
  per-(key, bucket) aggregate). Buckets bound the work per task by time.

* A key whose fullest time bucket holds more than ``ROWS_PER_PART`` rows is
  cut by row volume instead (``cut_by_volume``): a quantile sketch of the
  key's times gives the edges, so a card with most of its rows in one hour
  is spread over as many parts as its rows need.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risklib.session import scratch_path

HOUR_US = 3_600_000_000
ROWS_PER_PART = 1_000_000  # rows of one key that a window takes in one group
UNTIMED_GROUPS = 4096      # rows without a time are spread by id; they have no neighbours


def group_stats(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs)


def stats_once(df: DataFrame, columns: Sequence[str], aggs: Sequence[Column], name: str = "stats") -> dict[str, DataFrame]:
    """The aggregates of ``df`` grouped by each of ``columns``, all from one pass (grouping sets), as {column: (column, aggregates)}.

    The group table is written once and each column's groups are read from it.
    """
    columns = list(dict.fromkeys(columns))
    table = written(df.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(F.grouping_id().alias("_set"), *aggs), name)
    out = {}
    for i, c in enumerate(columns):
        others = [o for o in columns if o != c]
        # grouping_id has a 0 bit for a column that is grouped by, the first column highest
        mine = ((1 << len(columns)) - 1) & ~(1 << (len(columns) - 1 - i))
        out[c] = table.where(F.col("_set") == mine).drop("_set", *others)
    return out


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, out: str) -> DataFrame:
    """Add ``out``, the sum of ``weight`` over a key's rows up to and with the row, in the order of ``order`` (ties in any order).

    A key is spread over range partitions as in ``places_in_order``; the sums of the partitions before are added to a running
    sum inside the partition.
    """
    keys, by = list(keys), [*keys, *order]
    rows = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "running")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy(*keys, "_part").agg(F.sum(weight).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_inside", F.sum(weight).over(inside))
    return attach_stats(rows, parts, [*keys, "_part"], null_safe=True).withColumn(
        out, F.col("_before") + F.col("_inside")).drop("_at", "_part", "_before", "_inside")


def attach_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Left-join a keyed aggregate onto the rows (one row per key on the right)."""
    if not null_safe:
        return df.join(stats, on=list(keys), how="left")
    r = stats
    ren = {k: f"__r_{k}" for k in keys}
    for k, v in ren.items():
        r = r.withColumnRenamed(k, v)
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(r[ren[k]])
        cond = c if cond is None else cond & c
    return df.join(r, cond, "left").drop(*ren.values())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: row numbers stay as they are, and the lineage is cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str, name: str = "spread", rows_per_part: int = 250_000, least: int = 5_000) -> DataFrame:
    """``df`` checkpointed in partitions of at most about ``rows_per_part`` rows by the hash of ``key``, for jobs that read it many times.

    There is a partition for every core unless that leaves fewer than ``least`` rows in one. Rows of a partition lie in the order
    of the key (then of all columns that have an order), so fits that draw rows by partition or add up in order repeat themselves.
    """
    spark = df.sparkSession
    rows = written(df, name)
    n = rows.count()
    parts = max(1, min(spark.sparkContext.defaultParallelism, -(-n // least)), -(-n // rows_per_part))
    order = [F.col(key), *[vector_to_array(c) if isinstance(t.dataType, VectorUDT) else F.col(c) for c, t in
                           ((f.name, f) for f in df.schema.fields) if c != key and not isinstance(t.dataType, T.MapType)]]
    return rows.repartition(parts, key).sortWithinPartitions(*order).checkpoint()


def places_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "place") -> DataFrame:
    """Add ``out``, the 0-based place of each row of a key in the order of ``order``, ties in any order.

    Equal to ``row_number() over (partition by keys order by order) - 1``, but a key is
    spread over as many range partitions as its rows need: rows are range-partitioned and
    sorted by (keys, order), numbered inside each partition, and moved on by the key's rows
    in the partitions before (one small row per partition and key that meet).
    """
    keys, by = list(keys), [*keys, *order]
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
    rows = written(parts.withColumn("_at", F.monotonically_increasing_id()), "in-order").withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "_part", "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    return attach_stats(rows, runs, [*keys, "_part"], null_safe=True).withColumn(
        out, F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


def _spread_untimed(bucket: Column, id_col: str) -> Column:
    return F.coalesce(bucket.cast("long"), F.lit(-(1 << 40)) - F.pmod(F.xxhash64(id_col), F.lit(UNTIMED_GROUPS)))


def fits_time_buckets(df: DataFrame, keys: Sequence[str], ts_col: str, bucket_hours: float,
                      rows_per_part: int = ROWS_PER_PART) -> bool:
    """Does the fullest (key, time bucket) hold at most ``rows_per_part`` rows? One narrow aggregate."""
    b = F.floor(F.unix_micros(F.col(ts_col)) / F.lit(int(bucket_hours * HOUR_US)))
    n = df.where(F.col(ts_col).isNotNull()).groupBy(*keys, b.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    return (n.agg(F.max("_n")).first()[0] or 0) <= rows_per_part


def cut_by_volume(u: DataFrame, keys: Sequence[str], pos: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Add ``_b``: the part of the key's ``pos`` axis a row lies in, of about ``rows_per_part`` rows each.

    Keys with fewer rows are one part (0). For the others a quantile sketch per key gives the inner
    edges, and a row's part is the number of edges below its ``pos``. Parts rise with ``pos`` and equal
    ``pos`` share a part, so rows of a single instant are never cut. Null ``pos`` has a null part.
    """
    keys = list(keys)
    timed = u.where(F.col(pos).isNotNull()).select(*keys, pos)
    hot = timed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows_per_part)
    most = hot.agg(F.max("_n")).first()[0]
    if most is None:
        return u.withColumn("_b", F.when(F.col(pos).isNotNull(), F.lit(0).cast("long")))
    parts = math.ceil(most / rows_per_part)
    at = [i / parts for i in range(1, parts)]
    edges = (attach_stats(timed, hot, keys, null_safe=True).where(F.col("_n").isNotNull())
             .groupBy(*keys).agg(F.percentile_approx(pos, at, 10 * parts).alias("_edges")))
    edges = written(edges, "part-edges")  # a sketch depends on the order of its merges; every reader must see the same parts
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(parts.bit_length()))])
    below = F.aggregate(steps, F.lit(0), lambda i, step: F.when(
        F.try_element_at(F.col("_edges"), i + step) < F.col(pos), i + step).otherwise(i))
    return (attach_stats(u, edges, keys, null_safe=True)
            .withColumn("_b", F.when(F.col(pos).isNotNull(), below.cast("long"))).drop("_edges"))


def sequence_stage(df: DataFrame, keys: Sequence[str], ts_col: str, id_col: str,
                   prev_cols: Sequence[str] = (), ranges: dict[str, tuple[int, int]] | None = None,
                   bucket_hours: int = 168, rows_per_part: int | None = None) -> DataFrame:
    """Add ``_prev`` (struct of the previous row's ``prev_cols`` and ``_us``) and range counts.

    ``ranges`` maps an output column to a frame (lo_us, hi_us) relative to
    the row's event time, e.g. (-24h, 0) for [t-24h, t] or (-1h, -1) for
    [t-1h, t). Rows with a null time get a null ``_prev`` and count 0.
    Ordering of the previous row is (event time, id). With ``rows_per_part``
    the rows are cut by volume instead of time; ranges then come from
    ``range_counts_probe``.
    """
    ranges = dict(ranges or {})
    keys = list(keys)
    bucket_us = int(bucket_hours * HOUR_US)
    if rows_per_part is not None and ranges:
        raise ValueError("rows cut by volume hold no look-back rows; use range_counts_probe for ranges")
    max_back = max([-lo for lo, _ in ranges.values()] + [0])
    if max_back > bucket_us:
        raise ValueError("bucket_hours is shorter than the longest look-back; use range_counts_probe")
    us = F.unix_micros(F.col(ts_col))
    base = df.withColumns({"_us": us, "_own": F.lit(True)})
    base = (cut_by_volume(base, keys, "_us", rows_per_part) if rows_per_part is not None
            else base.withColumn("_b", F.floor(us / F.lit(bucket_us))))
    base = base.withColumn("_b", _spread_untimed(F.col("_b"), id_col))
    prev_fields = [F.col(c) for c in prev_cols] + [F.col("_us")]
    ctx_cols = list(dict.fromkeys(keys + [id_col, "_us", "_b"] + list(prev_cols)))
    u = base
    if max_back > 0:
        ctx = (base.where(F.col("_us") >= (F.col("_b") + 1) * F.lit(bucket_us) - F.lit(max_back))
                   .select(*ctx_cols).withColumns({"_b": F.col("_b") + 1, "_own": F.lit(False)}))
        u = base.unionByName(ctx, allowMissingColumns=True)
    part = keys + ["_b"]
    w_row = Window.partitionBy(*part).orderBy("_us", id_col)
    cols = {"_lag": F.lag(F.struct(*prev_fields)).over(w_row)}
    for name, (lo, hi) in ranges.items():
        w = Window.partitionBy(*part).orderBy("_us").rangeBetween(lo, hi)
        cols[name] = F.when(F.col("_us").isNotNull(), F.count(F.lit(1)).over(w)).otherwise(F.lit(0))
    out = u.withColumns(cols).where("_own")
    # previous row for the first row of a bucket: last row of the previous non-empty bucket
    last = (base.where(F.col("_us").isNotNull()).groupBy(*part)
                .agg(F.max_by(F.struct(*prev_fields), F.struct("_us", id_col)).alias("_last")))
    carry = last.select(*part, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("_carry"))
    out = attach_stats(out, carry, part, null_safe=True)
    prev = F.when(F.col("_us").isNotNull(), F.coalesce("_lag", "_carry"))
    return out.withColumn("_prev", prev).drop("_lag", "_carry", "_own", "_b")


def running_history(df: DataFrame, keys: Sequence[str], ts_col: str, id_col: str, value_col: str,
                    bucket_hours: int = 168, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Per row: count and sum of ``value_col`` over the key's earlier rows, and the key's first time.

    Earlier = smaller (time, id). Within a (key, time bucket) a running
    window adds rows of the bucket; the totals of all earlier buckets come
    from a per-(key, bucket) aggregate (small) with a cumulative sum over
    buckets, so no task holds more than one bucket of one key. When a time
    bucket holds more than ``rows_per_part`` rows, buckets are cut by volume.
    """
    keys = list(keys)
    base = df.withColumn("_us", F.unix_micros(F.col(ts_col)))
    if fits_time_buckets(df, keys, ts_col, bucket_hours, rows_per_part):
        base = base.withColumn("_b", F.floor(F.col("_us") / F.lit(int(bucket_hours * HOUR_US))))
    else:
        base = cut_by_volume(base, keys, "_us", rows_per_part)
    base = base.withColumn("_b", _spread_untimed(F.col("_b"), id_col))
    part = keys + ["_b"]
    # money is summed in whole cents (exact, order-independent; any engine gives the same bits)
    cents = F.round(F.col(value_col) * 100).cast("long")
    bt = base.where(F.col("_us").isNotNull()).groupBy(*part).agg(
        F.count(F.lit(1)).alias("_bc"), F.sum(cents).alias("_bs"), F.count(F.col(value_col)).alias("_bv"),
        F.min("_us").alias("_bmin"))
    wk = Window.partitionBy(*keys).orderBy("_b")
    prior = wk.rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(*part, F.coalesce(F.sum("_bc").over(prior), F.lit(0)).alias("_oc"),
                   F.coalesce(F.sum("_bs").over(prior), F.lit(0)).alias("_os"),
                   F.coalesce(F.sum("_bv").over(prior), F.lit(0)).alias("_ov"),
                   F.min("_bmin").over(Window.partitionBy(*keys)).alias("first_us"))
    wr = Window.partitionBy(*part).orderBy("_us", id_col).rowsBetween(Window.unboundedPreceding, -1)
    out = (base.withColumn("_rc", F.coalesce(F.count(F.lit(1)).over(wr), F.lit(0)))
               .withColumn("_rs", F.coalesce(F.sum(cents).over(wr), F.lit(0)))
               .withColumn("_rv", F.coalesce(F.count(F.col(value_col)).over(wr), F.lit(0))))
    out = attach_stats(out, bt, part, null_safe=True)
    return (out.withColumn("prior_count", F.when(F.col("_us").isNotNull(), F.col("_oc") + F.col("_rc")))
               .withColumn("prior_sum_cents", F.when(F.col("_us").isNotNull(), F.col("_os") + F.col("_rs")))
               .withColumn("prior_values", F.when(F.col("_us").isNotNull(), F.col("_ov") + F.col("_rv")))
               .drop("_b", "_rc", "_rs", "_rv", "_oc", "_os", "_ov"))


def hash_rank(df: DataFrame, part_cols: Sequence[str], key_col: str, seed: int = 42,
              buckets: int = 1 << 16) -> DataFrame:
    """0-based rank of each row inside ``part_cols`` by md5(key || seed), ties by key.

    Equivalent to ``row_number() over (partition by part order by md5) - 1``
    but a class holding most rows is spread over ``buckets`` ranges of the
    hash: per-(part, bucket) counts (small) give each range's offset and a
    window partitioned by (part, bucket) ranks inside it. The md5 form is
    reproducible in other engines.
    """
    part = list(part_cols)
    h = F.md5(F.concat(F.coalesce(F.col(key_col).cast("string"), F.lit("null")), F.lit(str(seed))))
    d = (df.withColumn("_h", h)
           .withColumn("_hb", F.floor(F.conv(F.substring("_h", 1, 6), 16, 10).cast("long") * buckets / F.lit(1 << 24)).cast("int")))
    bc = d.groupBy(*part, "_hb").agg(F.count(F.lit(1)).alias("_bc"))
    wb = Window.partitionBy(*part).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    bc = bc.select(*part, "_hb", F.coalesce(F.sum("_bc").over(wb), F.lit(0)).alias("_off"))
    wr = Window.partitionBy(*part, "_hb").orderBy("_h", key_col)
    r = d.withColumn("_rn", F.row_number().over(wr))
    # null-safe: rows with a null class are a class of their own and are kept
    return (attach_stats(r, bc, part + ["_hb"], null_safe=True)
             .withColumn("hash_rank", F.col("_off") + F.col("_rn") - 1)
             .drop("_h", "_hb", "_rn", "_off"))


def _times(df: DataFrame, keys: Sequence[str], us: Column) -> DataFrame:
    """(keys, _us, _rows): the distinct times of every key and their rows."""
    return df.select(*keys, us.alias("_us")).where(F.col("_us").isNotNull()).groupBy(*keys, "_us").agg(F.count(F.lit(1)).alias("_rows"))


def with_range_counts(df: DataFrame, keys: Sequence[str], ts_col: str, counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows with their counts from a table by (keys, _us); rows without a time count 0."""
    out = attach_stats(df.withColumn("_us", F.unix_micros(F.col(ts_col))), counts.select(*keys, "_us", *names), [*keys, "_us"], null_safe=True)
    return out.drop("_us").withColumns({n: F.coalesce(F.col(n), F.lit(0)).cast("long") for n in names})


def range_counts_by_time(df: DataFrame, keys: Sequence[str], ts_col: str, ranges: dict[str, tuple[int, int]],
                         bucket_hours: float = 168) -> DataFrame:
    """(keys, _us, _rows, counts): rows of the key in [t + lo, t + hi] at each of its times, from windows over time buckets.

    Only distinct (key, time) rows take part; those within the longest range before a bucket are copied into it.
    """
    keys = list(keys)
    bucket_us = int(bucket_hours * HOUR_US)
    back = max(-lo for lo, _ in ranges.values())
    if back > bucket_us or any(hi > 0 for _, hi in ranges.values()):
        raise ValueError("bucket_hours is shorter than the longest look-back; use range_counts_probe")
    base = _times(df, keys, F.unix_micros(F.col(ts_col))).withColumn("_b", F.floor(F.col("_us") / F.lit(bucket_us)))
    copied = base.where(F.col("_us") >= (F.col("_b") + 1) * F.lit(bucket_us) - F.lit(back)).withColumns(
        {"_b": F.col("_b") + 1, "_own": F.lit(False)})
    u = base.withColumn("_own", F.lit(True)).unionByName(copied)
    at = Window.partitionBy(*keys, "_b").orderBy("_us")
    return u.withColumns({n: F.coalesce(F.sum("_rows").over(at.rangeBetween(lo, hi)), F.lit(0)) for n, (lo, hi) in ranges.items()}).where(
        "_own").select(*keys, "_us", "_rows", *ranges)


def range_counts_probe(df: DataFrame, keys: Sequence[str], ts_col: str, id_col: str,
                       ranges: dict[str, tuple[int, int]], bucket_hours: float = 1.0,
                       rows_per_part: int | None = None) -> DataFrame:
    """The rows with the counts of ``probe_counts``."""
    counts = probe_counts(df, keys, ts_col, ranges, bucket_hours, rows_per_part)
    return with_range_counts(df, keys, ts_col, counts, list(ranges))


def probe_counts(df: DataFrame, keys: Sequence[str], ts_col: str, ranges: dict[str, tuple[int, int]], bucket_hours: float = 1.0,
                 rows_per_part: int | None = None) -> DataFrame:
    """(keys, _us, _rows, counts): exact counts of the key's rows in [t + lo, t + hi] (microsecond offsets) at each of its
    times, without context rows.

    count = C(t + hi) - C(t + lo - 1), where C(x) = rows of the key with time <= x.
    Each row emits one narrow probe per distinct offset. Probes and rows are
    partitioned by (key, bucket of the probe or row time): a running count
    of rows in the bucket (rows sort before probes at equal times) plus the
    rows of all earlier buckets (a small per-(key, bucket) prefix table)
    gives C at the probe. Because no look-back rows are copied, the bucket
    can be as short as wanted (default 1 h), so a card with a third of all
    rows is spread over as many tasks as it has active hours. The counts
    depend on (key, time) only, so rows of one key and time are one weighted probe row, and
    the result is joined back on key and time: ids may repeat or be null.
    With ``rows_per_part`` rows and probes are cut by volume instead, which
    bounds every part however the times lie.
    """
    keys = list(keys)
    bucket_us = int(bucket_hours * HOUR_US)
    offs = sorted({hi for _, hi in ranges.values()} | {lo - 1 for lo, _ in ranges.values()})
    us = F.unix_micros(F.col(ts_col))
    times = _times(df, keys, us)
    real = times.withColumns({"_pos": F.col("_us"), "_kind": F.lit(0), "_o": F.lit(None).cast("long")})
    probes = (real.select(*keys, "_us", "_rows", F.explode(F.array(*[F.lit(o).cast("long") for o in offs])).alias("_o"))
                  .withColumns({"_pos": F.col("_us") + F.col("_o"), "_kind": F.lit(1), "_of": F.col("_rows"), "_rows": F.lit(0).cast("long")}))
    u = real.withColumn("_of", F.lit(0).cast("long")).unionByName(probes)
    u = (cut_by_volume(u, keys, "_pos", rows_per_part) if rows_per_part is not None
         else u.withColumn("_b", F.floor(F.col("_pos") / F.lit(bucket_us))))
    w = Window.partitionBy(*keys, "_b").orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_inb", F.sum("_rows").over(w))
    bt = u.groupBy(*keys, "_b").agg(F.sum("_rows").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_pre"))
    pr = (attach_stats(u.where(F.col("_kind") == 1), bt, keys + ["_b"], null_safe=True)
           .select(*keys, "_us", "_o", "_of", (F.col("_pre") + F.col("_inb")).alias("_cle")))
    res = pr.groupBy(*keys, "_us").agg(F.max("_of").alias("_rows"), *[F.max(F.when(F.col("_o") == o, F.col("_cle"))).alias(f"_c{i}")
                                         for i, o in enumerate(offs)])
    idx = {o: i for i, o in enumerate(offs)}
    return res.select(*keys, "_us", "_rows", *[
        F.coalesce(F.col(f"_c{idx[hi]}") - F.col(f"_c{idx[lo - 1]}"), F.lit(0)).cast("long").alias(name) for name, (lo, hi) in ranges.items()])
