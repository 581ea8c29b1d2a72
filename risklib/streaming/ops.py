"""Structured Streaming operators (STR1-STR7).

Sources are file streams with an explicit schema. Event time is cast from
timestamp_ntz to timestamp (session zone UTC) because watermarks need it.
Sinks write parquet (or run foreachBatch) under the shared checkpoint
folder; queries in this repo run them with ``availableNow`` and read the
written table back, so nothing passes through the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risklib.session import scratch_path

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def event_stream(spark: SparkSession, path: str, file_glob: str | None = "events.parquet",
                 files_per_batch: int | None = None) -> DataFrame:
    """STR source: events parquet as a stream, mapped to the transaction columns."""
    r = spark.readStream.schema(EVENTS_SCHEMA)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    ev = r.parquet(path)
    return ev.select(
        F.col("event_id").alias("transaction_id"), F.col("user_id").alias("card_number"),
        F.col("value").alias("amount"), F.col("ts").cast("timestamp").alias("transaction_ts"),
        F.col("event_type").alias("merchant_category"),
        F.get_json_object("props", "$.k").try_cast("int").alias("mcc"),
        (F.col("event_type") == "error").cast("int").alias("fraud_indicator"))


NO_CARD = -(1 << 63)  # stands for a null card: a frame's column of whole numbers stays one


def card_groups(rows: int, rows_per_group: int = 50_000, least: int = 64) -> int:
    """Into how many groups the cards of a stream of about ``rows`` rows in all are dealt: a state's cost is per group and
    micro-batch, not per card, and a group's state and rows stay small. A stream keeps its number as long as its checkpoint."""
    return max(least, -(-rows // rows_per_group))


def card_group(card, groups: int):
    """The group of a card, by its hash."""
    return F.pmod(F.xxhash64(card), F.lit(groups)).cast("long")


# ---------------------------------------------------------------- STR1
def window_kpis(stream: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Tumbling event-time windows: count, fraud count, fraud rate, mean amount (append: closed windows)."""
    return (stream.withWatermark("transaction_ts", delay)
                  .groupBy(F.window("transaction_ts", window))
                  .agg(F.count(F.lit(1)).alias("transactions"), F.sum("fraud_indicator").cast("long").alias("fraud_count"),
                       F.avg("fraud_indicator").alias("fraud_rate"), F.avg("amount").alias("avg_amount"))
                  .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                          "transactions", "fraud_count", "fraud_rate", "avg_amount"))


# ---------------------------------------------------------------- STR2
SLIDING_OUT = "card_number long, start long, transactions long, amounts long, total_amount double"
SLIDING_STATE = "done long, cards array<long>, units array<long>, n array<long>, amounts array<long>, total array<double>"


def _summed(card, unit, *values):
    """One row per card and unit of time, in their order, with the sums of the values."""
    import numpy as np
    if not len(card):
        return (card, unit, *values)
    by = np.lexsort((unit, card))
    card, unit = card[by], unit[by]
    first = np.flatnonzero(np.r_[True, (card[1:] != card[:-1]) | (unit[1:] != unit[:-1])])
    return (card[first], unit[first], *(np.add.reduceat(v[by], first) for v in values))


def _sliding_fn(length: int, slide: int, rows_held: int = 200_000):
    """The state function of a group of cards for windows of ``length`` every ``slide`` microseconds.

    The state holds sums per card and unit of time (the largest that no window's edge cuts) as long as a window with that unit is
    open, not a row per card and window. A call gives the windows whose ends the watermark has reached since the call before.
    """
    import math
    unit_us = math.gcd(length, slide)

    def call(key, pdfs, state):
        import numpy as np
        import pandas as pd

        done, held = None, tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.float64))
        if state.exists:
            done, *arrays = state.get
            held = tuple(np.asarray(x, h.dtype) for x, h in zip(arrays, held))
        mark = state.getCurrentWatermarkMs() * 1000
        parts, waiting = [held], 0
        for pdf in [] if state.hasTimedOut else pdfs:
            has = pdf["has_amount"].to_numpy(np.int64)
            parts.append((pdf["card_number"].to_numpy(np.int64), pdf["us"].to_numpy(np.int64) // unit_us, np.ones(len(pdf), np.int64), has,
                          np.where(has == 1, pdf["amount"].to_numpy(np.float64), 0.0)))
            waiting += len(pdf)
            if waiting > rows_held:
                parts, waiting = [_summed(*(np.concatenate(x) for x in zip(*parts)))], 0
        card, unit, n, amounts, total = held = _summed(*(np.concatenate(x) for x in zip(*parts)))
        # every unit is part of the windows from the last that starts at or before it back to the first that ends after it
        at, last = unit * unit_us, unit * unit_us // slide * slide
        inside = [np.flatnonzero((at < last - k * slide + length) & (last - k * slide + length <= mark)
                                 & ((last - k * slide + length > done) if done is not None else True)) for k in range(-(-length // slide))]
        who = np.concatenate(inside)
        start = np.concatenate([last[i] - k * slide for k, i in enumerate(inside)])
        card, start, n, amounts, total = _summed(card[who], start, n[who], amounts[who], total[who])
        keep = held[1] * unit_us // slide * slide + length > mark
        state.update((mark if done is None else max(mark, done), *(x[keep].tolist() for x in held)))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 1)  # called again as soon as the watermark moves
        for i in range(0, len(card), rows_held):
            j = slice(i, i + rows_held)
            yield pd.DataFrame({"card_number": card[j], "start": start[j], "transactions": n[j], "amounts": amounts[j], "total_amount": total[j]})

    return call


def _micros(interval: str) -> int:
    import pandas as pd
    return pd.Timedelta(interval) // pd.Timedelta(microseconds=1)


def sliding_velocity(stream: DataFrame, length: str = "24 hours", slide: str = "1 hour", delay: str = "1 hour", groups: int = 64) -> DataFrame:
    """Per card counts in sliding windows (bucketed form of the exact WIN6 counts), of closed windows as ``F.window`` gives them.

    A window aggregate holds a state row for every card and open window, each row of the stream in ``length / slide`` of them; here the
    cards are dealt over ``groups`` states (``card_groups``) of sums per card and slide. A row counts in those of its windows that are
    still open."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    whole = _micros(length)
    # the watermark on the time at which a row's windows are all closed, moved on by as much, is that of the row times; rows behind it go
    s = (stream.where("transaction_ts IS NOT NULL")
               .withColumn("_closed", F.timestamp_micros(F.unix_micros("transaction_ts") + F.lit(whole)))
               .withWatermark("_closed", f"{_micros(delay) + whole} microseconds")
               .select(F.coalesce("card_number", F.lit(NO_CARD)).alias("card_number"), F.unix_micros("transaction_ts").alias("us"),
                       F.col("amount").cast("double").alias("amount"), F.col("amount").isNotNull().cast("long").alias("has_amount"), "_closed",
                       card_group(F.col("card_number"), groups).alias("_group")))
    out = s.groupBy("_group").applyInPandasWithState(
        _sliding_fn(whole, _micros(slide)), SLIDING_OUT, SLIDING_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    # a sum that is not a number arrives as null
    return out.select(F.nullif("card_number", F.lit(NO_CARD)).alias("card_number"), F.timestamp_micros("start").alias("window_start"),
                      F.timestamp_micros(F.col("start") + F.lit(whole)).alias("window_end"), "transactions",
                      F.when(F.col("amounts") > 0, F.coalesce("total_amount", F.lit(float("nan")))).alias("total_amount"))


# ---------------------------------------------------------------- STR3
def card_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return (stream.withWatermark("transaction_ts", delay)
                  .groupBy("card_number", F.session_window("transaction_ts", gap))
                  .agg(F.count(F.lit(1)).alias("transactions"), F.sum("amount").alias("total_amount"))
                  .select("card_number", F.col("session_window.start").alias("session_start"),
                          F.col("session_window.end").alias("session_end"), "transactions", "total_amount"))


# ---------------------------------------------------------------- STR6
def dedup_events(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("transaction_ts", delay).dropDuplicatesWithinWatermark(["transaction_id"])


# ---------------------------------------------------------------- sinks
def run_to_parquet(df: DataFrame, name: str, mode: str = "append") -> str:
    """Run a streaming DataFrame to completion (availableNow) into a parquet folder; return its path."""
    spark = df.sparkSession
    out = scratch_path(spark, name)
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", os.path.join(out, "data"))
           .option("checkpointLocation", os.path.join(out, "_checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    return os.path.join(out, "data")


def run_foreach_batch(df: DataFrame, name: str, fn) -> str:
    """foreachBatch sink: ``fn(batch_df, epoch_id, out_path)`` writes each micro-batch (idempotent by epoch)."""
    spark = df.sparkSession
    out = scratch_path(spark, name)
    data = os.path.join(out, "data")
    q = (df.writeStream.foreachBatch(lambda b, e: fn(b, e, data))
           .option("checkpointLocation", os.path.join(out, "_checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    return data


# ---------------------------------------------------------------- STR4
def state_session(spark: SparkSession, rows: int, rows_per_part: int = 500_000) -> SparkSession:
    """A session of the same application for a stream with state over about ``rows`` rows in all.

    Every micro-batch opens and commits the state store of every shuffle partition, however few rows it
    has, so there are as many partitions as cores, and more only where the rows need them.
    """
    s = spark.newSession()
    for k in ("spark.sql.session.timeZone", "spark.sql.streaming.stateStore.providerClass"):
        s.conf.set(k, spark.conf.get(k))
    s.conf.set("spark.sql.shuffle.partitions", str(max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_part))))
    return s


STATE_OUT = ("transaction_id long, card_number long, minutes_since_last double, amount_diff double, "
             "history_mean_amount double, tx_count_24h long")
STATE_SCHEMA = ("cards array<long>, last_us array<long>, last_amount array<double>, n array<long>, total array<double>, "
                "recent_rows array<long>, recent array<long>")
DAY_US = 86_400_000_000


def _continue_card(us, amt, held):
    """(minutes, difference, history mean, 24 h count) of one card's rows in (time, id) order, and its next state.

    The state keeps the largest time seen with its amount, the running count
    and sum, and the event times of the 24 h before that time. A row that arrives
    behind the last time gets no negative gap: its previous row is unknown to
    the state unless it is in the same batch, so its gap and difference are
    null, and it does not move the last time back.
    """
    import numpy as np

    last_us, last_amount, n, total, recent = held if held is not None else (None, None, 0, 0.0, np.zeros(0, dtype="int64"))
    prev_us = np.concatenate([[np.nan], us[:-1]]).astype("float64")
    prev_amt = np.concatenate([[np.nan], amt[:-1]])
    late = np.zeros(len(us), dtype=bool)
    if last_us is not None:
        late = us < last_us
        first = int(late.sum())  # rows are in time order: the first row that is not late follows the state's last row
        if first < len(us):
            prev_us[first], prev_amt[first] = last_us, last_amount
    minutes = np.where(np.isnan(prev_us), np.where(late, np.nan, 99999.0), (us - prev_us) / 60_000_000.0)
    cents = np.round(amt * 100).astype("int64")   # money in whole cents: exact running sums
    cnt_before = n + np.arange(len(us))
    sum_before = int(total) + np.concatenate([[0], np.cumsum(cents)[:-1]])
    hist_mean = np.where(cnt_before > 0, (sum_before.astype("float64") / 100.0) / np.maximum(cnt_before, 1), np.nan)
    all_us = np.sort(np.concatenate([recent, us]))
    c24 = np.searchsorted(all_us, us, side="right") - np.searchsorted(all_us, us - DAY_US, side="left")
    if last_us is None or int(us[-1]) >= last_us:
        last_us, last_amount = int(us[-1]), float(amt[-1])
    keep = all_us[all_us >= last_us - DAY_US]
    return ((minutes, amt - prev_amt, hist_mean, c24.astype("int64")),
            (last_us, last_amount, int(n + len(us)), float(int(total) + int(cents.sum())), keep))


def _frame_of(pdf, parts):
    import pandas as pd
    minutes, diff, mean, c24 = parts
    return pd.DataFrame({"transaction_id": pdf["transaction_id"].to_numpy(), "card_number": pdf["card_number"].to_numpy(),
                         "minutes_since_last": minutes, "amount_diff": diff, "history_mean_amount": mean, "tx_count_24h": c24})


def _card_state_fn(key, pdfs, state):
    """A group that is one card, its state (last time and amount, count, sum, times of the last 24 h).

    The timeout (watermark past last time + 24 h) empties only the list of times: count,
    sum, last time and amount live as long as the card.
    """
    import numpy as np
    import pandas as pd

    if state.hasTimedOut:
        last_us, last_amount, n, total, _ = state.get
        state.update((last_us, last_amount, n, total, []))
        return
    pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["_us", "transaction_id"], kind="mergesort")
    held = None
    if state.exists:
        *rest, recent = state.get
        held = (*rest, np.asarray(recent if recent is not None else [], dtype="int64"))
    parts, (last_us, last_amount, n, total, keep) = _continue_card(
        pdf["_us"].to_numpy(dtype="int64"), pdf["amount"].to_numpy(dtype="float64"), held)
    state.update((last_us, last_amount, n, total, keep.tolist()))
    expire = last_us // 1000 + DAY_US // 1000
    if expire > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(expire)
    yield _frame_of(pdf, parts).assign(card_number=key[0])


def _card_group_fn(key, pdfs, state):
    """A group of many cards: each card's rows of the micro-batch continue its part of the state (``_continue_card``).

    Times that are 24 h behind the watermark go, whether their card has rows or not; the timeout
    (watermark past the group's last time + 24 h) empties the lists of all cards.
    """
    import numpy as np
    import pandas as pd

    cards, last_us, last_amount, n, total, recent_rows, recent = (list(x) for x in state.get) if state.exists else ([] for _ in range(7))
    if state.hasTimedOut:
        state.update((cards, last_us, last_amount, n, total, [0] * len(cards), []))
        return
    place = {c: i for i, c in enumerate(cards)}
    lists = np.split(np.asarray(recent, dtype="int64"), np.cumsum(recent_rows, dtype="int64")[:-1]) if cards else []
    pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(["card_number", "_us", "transaction_id"], kind="mergesort")
    card, us, amt = pdf["card_number"].to_numpy(dtype="int64"), pdf["_us"].to_numpy(dtype="int64"), pdf["amount"].to_numpy(dtype="float64")
    starts = np.flatnonzero(np.r_[True, card[1:] != card[:-1]])
    found = []
    for s, e in zip(starts, np.r_[starts[1:], len(card)]):
        c = int(card[s])
        i = place.get(c)
        held = None if i is None else (last_us[i], last_amount[i], n[i], total[i], lists[i])
        parts, (lu, la, cn, ct, keep) = _continue_card(us[s:e], amt[s:e], held)
        found.append(parts)
        if i is None:
            cards.append(c)
            last_us.append(lu)
            last_amount.append(la)
            n.append(cn)
            total.append(ct)
            lists.append(keep)
        else:
            last_us[i], last_amount[i], n[i], total[i], lists[i] = lu, la, cn, ct, keep
    mark = state.getCurrentWatermarkMs()
    every, owner = np.concatenate(lists), np.repeat(np.arange(len(cards)), [len(x) for x in lists])
    needed = every >= mark * 1000 - DAY_US  # later rows are not behind the watermark
    state.update((cards, last_us, last_amount, n, total, np.bincount(owner[needed], minlength=len(cards)).tolist(), every[needed].tolist()))
    expire = max(last_us) // 1000 + DAY_US // 1000
    if expire > mark:
        state.setTimeoutTimestamp(expire)
    yield _frame_of(pdf, [np.concatenate(x) for x in zip(*found)])


def stateful_card_features(stream: DataFrame, delay: str = "1 hour", groups: int = 64) -> DataFrame:
    """Per arriving row: minutes since the card's previous row, amount difference, mean of earlier
    amounts and rows in [t - 24 h, t]. Equals the batch WIN3/WIN1/AGG24/WIN5 values on input that is in
    order over the micro-batches (of any number); rows within a batch may come in any order. The cards are
    dealt over ``groups`` states (``card_groups``)."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    s = (stream.withColumn("_us", F.unix_micros("transaction_ts")).withWatermark("transaction_ts", delay)
               .select("transaction_id", F.coalesce("card_number", F.lit(NO_CARD)).alias("card_number"), "amount", "transaction_ts", "_us",
                       card_group(F.col("card_number"), groups).alias("_group")))
    out = s.groupBy("_group").applyInPandasWithState(
        _card_group_fn, STATE_OUT, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("card_number", F.nullif("card_number", F.lit(NO_CARD)))


# ---------------------------------------------------------------- STR5
def score_stream(stream: DataFrame, profile: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Stream-static join with the card profile (history aggregate) + rule score; alert rows only."""
    from risklib.operators.scores import rule_score
    s = stream.join(profile, "card_number", "left")
    scored_s = rule_score(s, threshold)
    return (scored_s.withColumn("amount_to_profile_ratio", F.try_divide(F.col("amount"), F.col("profile_avg_amount")))
                    .where(F.col("is_fraud") == 1))


def card_profile(history: DataFrame) -> DataFrame:
    return history.groupBy("card_number").agg(F.avg("amount").alias("profile_avg_amount"),
                                              F.count(F.lit(1)).alias("profile_transactions"))


def write_alerts(batch: DataFrame, epoch_id: int, out: str) -> None:
    """Idempotent per epoch: a replayed epoch overwrites its own folder."""
    batch.write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch_id}"))


# ---------------------------------------------------------------- STR7
def replay_by_day(spark: SparkSession, events: DataFrame, name: str = "replay", rows_per_file: int = 1_000_000) -> str:
    """Write events as files in time order, so that a file stream with one file per trigger replays them in
    order; returns the folder.

    The table is read once, into a copy partitioned by day. Each day is then one file, or several slices of its
    times where it has more than ``rows_per_file`` rows, so no task writes more than one slice.
    """
    base, staged = scratch_path(spark, name), scratch_path(spark, f"{name}-days")
    rows = events.columns
    events.withColumn("_d", F.to_date("ts")).repartitionByRange("ts").write.partitionBy("_d").parquet(staged)
    by_day = spark.read.parquet(staged)
    days = by_day.groupBy("_d").agg(F.count(F.lit(1)).alias("n")).orderBy("_d").collect()  # one row per day
    for d in days:
        one = by_day.where(F.col("_d") == F.lit(d["_d"]) if d["_d"] is not None else F.col("_d").isNull())  # reads this day's files only
        k = -(-d["n"] // rows_per_file)
        edges = []
        if k > 1 and d["_d"] is not None:
            us = F.unix_micros(F.col("ts").cast("timestamp"))
            edges = sorted(set(one.agg(F.percentile_approx(us, [i / k for i in range(1, k)], 10 * k).alias("e")).first()["e"]))
        for lo, hi in zip([None, *edges], [*edges, None]):
            part = one
            for edge, inside in ((lo, lambda t, e: t > e), (hi, lambda t, e: t <= e)):
                if edge is not None:
                    part = part.where(inside(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(edge)))
            part.select(*rows).coalesce(1).write.mode("append").parquet(base)
    return base


def late_data_report(spark: SparkSession, events_dir: str, split_ts: str = "2024-01-16", delay: str = "1 hour") -> DataFrame:
    """Replay events out of order: rows after ``split_ts`` first, earlier rows as a second run.

    A row is late when its time is behind the watermark the stream had reached
    before its micro-batch (largest time of the earlier runs minus ``delay``).
    Late rows are counted before any aggregation. Returns one row per run:
    input rows, late rows, and the rows that reached the hourly windows' input.
    """
    from risklib.sources.tables import read_table
    base = scratch_path(spark, "late")
    src = os.path.join(base, "src")
    ev = read_table(spark, events_dir, "events")
    cut = F.lit(split_ts).cast("timestamp_ntz")
    out = os.path.join(base, "out")

    def count(batch: DataFrame, epoch: int) -> None:
        seen = batch.sparkSession.read.schema(_LATE).option("recursiveFileLookup", "true").parquet(out) if epoch else None
        top = seen.agg(F.max("max_ts")).first()[0] if seen is not None else None
        mark = F.lit(top).cast("timestamp") - F.expr(f"INTERVAL {delay}") if top is not None else F.lit(None).cast("timestamp")
        late = F.coalesce(F.col("transaction_ts") < mark, F.lit(False))
        (batch.agg(F.lit(epoch).cast("long").alias("batch_id"), F.count(F.lit(1)).alias("input_rows"),
                   F.sum(late.cast("long")).alias("late_rows"), F.max("transaction_ts").alias("max_ts"))
              .write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch}")))

    for part in (ev.where(F.col("ts") >= cut), ev.where(F.col("ts") < cut)):
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(EVENTS_SCHEMA).parquet(src).select(F.col("ts").cast("timestamp").alias("transaction_ts"))
        q = (stream.writeStream.foreachBatch(count).option("checkpointLocation", os.path.join(base, "_ck"))
                   .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(_LATE).option("recursiveFileLookup", "true").parquet(out).select(
        (F.col("batch_id") + 1).cast("int").alias("run"), "input_rows", "late_rows",
        (F.col("input_rows") - F.col("late_rows")).alias("on_time_rows"))


_LATE = "batch_id long, input_rows long, late_rows long, max_ts timestamp"
