from pyspark.sql import functions as F

from risklib.streaming import ops as S
from tests.conftest import SF0001


def test_stateful_stream_equals_batch_over_many_batches(spark):
    import __spark_entry__ as E
    import duckdb
    got = E.queries()["str4_stateful_card_features"](spark, SF0001).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF0001}/events.parquet')")
    ref = con.sql(E.oracle_sql()["str4_stateful_card_features"]).df()
    m = got.merge(ref, on="transaction_id", suffixes=("", "_r"))
    assert len(m) == len(ref) == len(got)
    assert (m.tx_count_24h == m.tx_count_24h_r).all()
    assert ((m.minutes_since_last - m.minutes_since_last_r).abs() < 1e-6).all()
    both = m.history_mean_amount.notna()
    assert (both == m.history_mean_amount_r.notna()).all()
    assert ((m.history_mean_amount - m.history_mean_amount_r).abs()[both] < 1e-6).all()


class State:
    """The part of a group state that the card function uses."""

    def __init__(self, value=None, timed_out=False):
        self.get, self.exists, self.hasTimedOut, self.timeout = value, value is not None, timed_out, None

    def update(self, v):
        self.get, self.exists = v, True

    def setTimeoutTimestamp(self, t):
        self.timeout = t

    def getCurrentWatermarkMs(self):
        return 0


def _step(state, rows):
    import pandas as pd
    pdf = pd.DataFrame(rows, columns=["transaction_id", "card_number", "amount", "_us"])
    return next(S._card_state_fn((1,), iter([pdf]), state)).set_index("transaction_id")


def test_late_rows_do_not_move_the_state_back():
    m = 60_000_000
    state = State()
    _step(state, [(1, 1, 10.0, 100 * m), (2, 1, 20.0, 110 * m)])
    late = _step(state, [(3, 1, 5.0, 50 * m)])
    assert late.minutes_since_last.isna().all() and late.amount_diff.isna().all()
    assert state.get[0] == 110 * m and state.get[1] == 20.0 and state.get[2] == 3
    after = _step(state, [(4, 1, 1.0, 60 * m), (5, 1, 30.0, 115 * m)])
    assert after.loc[5, "minutes_since_last"] == 5 and after.loc[5, "amount_diff"] == 10


def test_timeout_empties_only_the_recent_times():
    state = State((7, 1.0, 4, 1000.0, [5, 7]), timed_out=True)
    list(S._card_state_fn((1,), iter([]), state))
    assert state.get == (7, 1.0, 4, 1000.0, [])


def test_late_rows_are_counted_before_aggregation(spark):
    rep = {r["run"]: r for r in S.late_data_report(spark, SF0001).collect()}
    ev = spark.read.parquet(f"{SF0001}/events.parquet")
    top = ev.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).first()[0]
    early = ev.where("ts < timestamp_ntz'2024-01-16'")
    assert rep[1]["late_rows"] == 0 and rep[1]["input_rows"] + rep[2]["input_rows"] == ev.count()
    assert rep[2]["late_rows"] == early.where(F.col("ts") < F.lit(top)).count() > 0


def test_window_kpis_closed_windows_only(spark):
    p = S.run_to_parquet(S.window_kpis(S.event_stream(spark, SF0001)), "t-str1")
    d = spark.read.parquet(p)
    mx = spark.read.parquet(f"{SF0001}/events.parquet").agg(F.max("ts")).first()[0]
    assert d.agg(F.max("window_end")).first()[0].replace(tzinfo=None) <= mx


def _events(spark, rows):
    """(event_id, hours since the first day, card, amount) as the events table."""
    df = spark.createDataFrame(rows, "event_id long, h double, user_id long, value double")
    return df.select("event_id", F.expr("cast(timestamp_micros(1704067200000000 + cast(h * 3600000000 as long)) as timestamp_ntz)").alias("ts"),
                     "user_id", F.lit("view").alias("event_type"), "value", F.lit('{"k": 1}').alias("props"))


def _replayed(spark, parts):
    """The processor's rows by event_id, one micro-batch per list of rows."""
    from risklib.session import scratch_path
    from risklib.streaming.card_state import card_state_features
    src = scratch_path(spark, "t-card-state")
    for rows in parts:
        _events(spark, rows).coalesce(1).write.mode("append").parquet(src)
    p = S.run_to_parquet(card_state_features(S.event_stream(spark, src, None, files_per_batch=1)), "t-card-state")
    return {r["transaction_id"]: r for r in spark.read.parquet(p).collect()}


def test_processor_late_rows_and_expired_hours(spark):
    got = _replayed(spark, [
        [(1, 0.0, 7, 10.0), (2, 5.0, 7, 20.0), (3, 5.0, 8, 1.0)],
        [(4, 23.5, 7, 30.0)], [(5, 23.0, 7, 40.0)], [(6, 24.0, 7, 50.0)], [(7, 80.0, 7, 1.0)], [(8, 100.0, 7, 2.0), (9, 99.0, 7, 3.0)]])
    assert [got[i]["tx_count_24h"] for i in (1, 2, 3, 4, 5, 6, 7)] == [1, 2, 1, 3, 3, 5, 1]
    assert got[5]["minutes_since_last"] is None and got[5]["amount_diff"] is None  # behind the last time
    assert got[6]["minutes_since_last"] == 30 and got[6]["amount_diff"] == 20
    assert got[1]["minutes_since_last"] == 99999.0 and got[1]["history_mean_amount"] is None
    assert got[4]["history_mean_amount"] == 15 and got[7]["history_mean_amount"] == 30
    assert got[9]["tx_count_24h"] == 2 and got[8]["minutes_since_last"] == 60


def test_processor_takes_a_card_with_100_000_rows_a_day(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    h = np.sort(rng.uniform(0, 48, 200_000))
    us = (h * 3600000000).astype(np.int64)
    rows = list(zip(range(200_000), h.tolist(), [7] * 200_000, [1.0] * 200_000))
    got = _replayed(spark, [rows[:100_000], rows[100_000:]])
    want = np.searchsorted(us, us, "right") - np.searchsorted(us, us - 86_400_000_000, "left")
    assert len(got) == 200_000 and all(got[i]["tx_count_24h"] == want[i] for i in range(0, 200_000, 37))


def test_replay_keeps_time_order_over_slices(spark):
    rows = [(i, i * 0.5, i % 3, 1.0) for i in range(200)]
    base = S.replay_by_day(spark, _events(spark, rows).repartition(4), "t-replay", rows_per_file=20)
    files = spark.read.parquet(base).select("event_id", F.input_file_name().alias("f"), F.col("_metadata.file_modification_time").alias("m"))
    spans = sorted((r["m"], r["lo"], r["hi"], r["n"]) for r in files.groupBy("f").agg(
        F.min("m").alias("m"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.count(F.lit(1)).alias("n")).collect())
    assert sum(s[3] for s in spans) == 200 and len(spans) > 8 and max(s[3] for s in spans) <= 30
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_cards_of_a_group_share_one_state_and_keep_their_own_features():
    """Many cards in one call a micro-batch give each card the rows of a state of its own, late rows and a timeout between included."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(3)
    group, own, h = State(), {}, 3_600_000_000
    for b in range(5):
        if b == 3:
            group.hasTimedOut = True
            list(S._card_group_fn((0,), iter([]), group))
            group.hasTimedOut = False
        rows = [(b * 1000 + i, int(rng.integers(0, 40)), round(float(rng.uniform(1, 90)), 2), int((b * 12 + rng.uniform(-2, 12) + (30 if b > 2 else 0)) * h))
                for i in range(200)]
        pdf = pd.DataFrame(rows, columns=["transaction_id", "card_number", "amount", "_us"])
        got = pd.concat(S._card_group_fn((0,), iter([pdf[:90], pdf[90:]]), group)).sort_values("transaction_id", ignore_index=True)
        parts = []
        for c, one in pdf.groupby("card_number"):
            parts += list(S._card_state_fn((c,), iter([one]), own.setdefault(c, State())))
        want = pd.concat(parts).sort_values("transaction_id", ignore_index=True)
        pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False)
    assert sorted(group.get[0]) == sorted(own) and len(group.get[6]) == sum(group.get[5])


def test_states_are_as_many_as_groups_of_cards(spark):
    """500 cards are 8 states, not 500: a state's cost is per micro-batch, however few rows a card has."""
    from risklib.session import scratch_path
    src = scratch_path(spark, "t-groups")
    _events(spark, [(i, i / 50, i % 500, 1.0) for i in range(1_000)]).coalesce(1).write.parquet(src)
    out = scratch_path(spark, "t-groups-out")
    q = (S.stateful_card_features(S.event_stream(spark, src, None), groups=8).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", f"{out}-ck").trigger(availableNow=True).start())
    q.awaitTermination()
    assert max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]) == 8
    assert spark.read.parquet(out).count() == 1_000 and S.card_groups(36_000_000) == 720 and S.card_groups(0) == 64


def test_processor_features_do_not_depend_on_the_groups_of_cards(spark):
    """60 cards, unsorted and late rows, whole days without rows: one group or many, and the 24 h counts are exact."""
    import numpy as np
    from risklib.session import scratch_path
    from risklib.streaming.card_state import card_state_features
    rng = np.random.default_rng(9)
    src, parts = scratch_path(spark, "t-processor-groups"), []
    for b, day in enumerate((0, 1, 2, 5)):
        t = np.round(rng.uniform(24 * day - (0.9 if b else 0), 24 * day + 23, 400), 3)
        t[0] = 24 * day + 23
        parts.append([(b * 1000 + i, float(t[i]), int(rng.integers(0, 60)), round(float(rng.uniform(1, 99)), 2)) for i in range(400)])
        _events(spark, parts[-1]).coalesce(1).write.mode("append").parquet(src)
    got = []
    for groups in (1, 16):
        p = S.run_to_parquet(card_state_features(S.event_stream(spark, src, None, files_per_batch=1), groups=groups), "t-processor-groups")
        got.append(sorted(spark.read.parquet(p).collect()))
    assert got[0] == got[1] and len(got[0]) == 1_600
    us = {r[0]: (r[2], int(r[1] * 3600000000)) for rows in parts for r in rows}
    for r in got[0]:
        c, t = us[r["transaction_id"]]
        batch = r["transaction_id"] // 1000  # rows of later batches had not come yet
        assert r["card_number"] == c
        assert r["tx_count_24h"] == sum(c2 == c and t - 86_400_000_000 <= t2 <= t and i // 1000 <= batch for i, (c2, t2) in us.items())


def _windows(spark, parts, build):
    """Rows of a window stream, one micro-batch per list of rows, and the largest number of rows its states had."""
    from risklib.session import scratch_path
    src, out = scratch_path(spark, "t-sliding"), scratch_path(spark, "t-sliding-out")
    for rows in parts:
        _events(spark, rows).coalesce(1).write.mode("append").parquet(src)
    q = (build(S.event_stream(spark, src, None, files_per_batch=1)).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", f"{out}-ck").trigger(availableNow=True).start())
    q.awaitTermination()
    rows = sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=str)
    return rows, max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"])


def test_sliding_windows_are_sums_of_slides_and_not_a_state_row_each(spark):
    """Late rows, null amounts and cards, days without rows and a length that the slide does not divide: as Spark's own windows."""
    import numpy as np
    rng = np.random.default_rng(6)
    parts = []
    for b, at in enumerate((0, 20, 30, 120)):
        h = np.round(rng.uniform(at - (5 if b else 0), at + 20, 150), 2)
        h[0] = at + 20
        parts.append([(b * 1000 + i, float(h[i]), None if i % 50 == 7 else int(rng.integers(0, 9)), None if i % 6 == 0 else float(rng.integers(1, 99)))
                      for i in range(150)])
    for length, slide in (("24 hours", "1 hour"), ("150 minutes", "60 minutes")):
        def native(stream, length=length, slide=slide):
            return (stream.withWatermark("transaction_ts", "1 hour").groupBy("card_number", F.window("transaction_ts", length, slide))
                    .agg(F.count(F.lit(1)).alias("transactions"), F.sum("amount").alias("total_amount"))
                    .select("card_number", "window.start", "window.end", "transactions", "total_amount"))
        want, many = _windows(spark, parts, native)
        got, few = _windows(spark, parts, lambda s, length=length, slide=slide: S.sliding_velocity(s, length, slide, groups=4))
        assert got == want and len(got) > 100 and few <= 4 < many


def test_sums_that_are_not_numbers_stay_in_their_windows(spark):
    nan = float("nan")
    got, _ = _windows(spark, [[(1, 0.5, 1, 1.0), (2, 1.5, 1, nan), (3, 3.5, 1, 2.0), (4, 9.0, 2, None), (5, 60.0, 3, 1.0)]],
                      lambda s: S.sliding_velocity(s, "2 hours", "1 hour"))
    zero = min(r[1] for r in got)
    # card 3's windows are open; the sum of amounts that are all null is null
    assert sorted((r[0], (r[1] - zero).total_seconds() / 3600, r[3], str(r[4])) for r in got) == [
        (1, 0, 1, "1.0"), (1, 1, 2, "nan"), (1, 2, 1, "nan"), (1, 3, 1, "2.0"), (1, 4, 1, "2.0"), (2, 9, 1, "None"), (2, 10, 1, "None")]
