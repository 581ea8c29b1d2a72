"""STR4 as a stateful processor: values, maps by hour and event-time timers per group of cards.

Every access to a state is a round trip between Python and the JVM, so the key is a group of cards (by hash), not a card.
A group's state is a value (each card's last time and amount, rows so far and their sum) and two
maps keyed by the hour of event time: the cards of the hour with their numbers of rows, and the times of these rows. A row's
24 h count is the sum of 23 whole hours from the first map and two lookups, in
its own hour and in the hour a day before, in the second. So a busy card's day is 25
parts and never one array, and a micro-batch reads and writes only the hours that
its rows touch. Each hour has a timer; when the watermark is 24 h past the hour's
end, both entries go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from risklib.streaming.ops import NO_CARD, card_group

HOUR_US, DAY_HOURS = 3_600_000_000, 24
SPAN = HOUR_US + 1  # a card's times within an hour, and one place after them
NO_PREVIOUS = 99999.0
OUT = ("transaction_id long, card_number long, minutes_since_last double, amount_diff double, "
       "history_mean_amount double, tx_count_24h long")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NONE = np.zeros(0, np.int64)


def _long(x) -> np.ndarray:
    return np.asarray(x, np.int64)


class CardState(StatefulProcessor):
    """Minutes and amount since the card's previous row, mean of its earlier amounts, rows in [t - 24 h, t]."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "cards array<long>, us array<long>, amount array<double>, n array<long>, cents array<long>")
        self.count_of = handle.getMapState("counts", "hour long", "cards array<long>, n array<long>")
        self.times_of = handle.getMapState("times", "hour long", "times array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["card_number", "us", "transaction_id"], kind="mergesort")
        card, us, amount = frame["card_number"].to_numpy(np.int64), frame["us"].to_numpy(np.int64), frame["amount"].to_numpy(np.float64)
        first = np.flatnonzero(np.r_[True, card[1:] != card[:-1]])  # of every card of the micro-batch
        size = np.diff(np.r_[first, len(card)])
        state = self.last.get() if self.last.exists() else ([], [], [], [], [])
        # every card of the state and the micro-batch has a place ``of`` the state's arrays
        cards = np.union1d(_long(state[0]), card[first])
        n_cards, old = len(cards), np.searchsorted(cards, _long(state[0]))
        of, spot = np.searchsorted(cards, card), np.searchsorted(cards, card[first])
        known = np.zeros(n_cards, bool)
        last_us, n, cents, last_amount = (np.zeros(n_cards, t) for t in (np.int64, np.int64, np.int64, np.float64))
        known[old], last_us[old], last_amount[old], n[old], cents[old] = True, *map(np.asarray, state[1:])
        # the previous row; a row behind the last time has none that the state knows
        starts = np.zeros(len(us), bool)
        starts[first] = True
        prev_us, prev_amount = np.concatenate([[np.nan], us[:-1]]), np.concatenate([[np.nan], amount[:-1]])
        prev_us[starts] = prev_amount[starts] = np.nan
        late = known[of] & (us < last_us[of])
        after = known[of] & ~late & (starts | np.r_[False, late[:-1]])  # the first row of its card that is not late
        prev_us[after], prev_amount[after] = last_us[of[after]], last_amount[of[after]]
        minutes = np.where(np.isnan(prev_us), np.where(late, np.nan, NO_PREVIOUS), (us - prev_us) / 60_000_000.0)
        own_cents = np.round(np.nan_to_num(amount) * 100).astype(np.int64)
        begin = np.repeat(first, size)
        before = n[of] + np.arange(len(us)) - begin
        run = np.concatenate([[0], np.cumsum(own_cents)])
        sums = cents[of] + run[:-1] - run[begin]
        history = np.where(before > 0, sums / 100.0 / np.maximum(before, 1), np.nan)
        # the rows of the last 24 h, by the parts of an hour
        held = {k[0]: (np.searchsorted(cards, _long(v[0])), _long(v[1])) for k, v in self.count_of.iterator()}
        hours = us // HOUR_US
        by_hour = np.argsort(hours, kind="stable")  # within an hour by card, then by time
        new_hours, start, new_counts = np.unique(hours[by_hour], return_index=True, return_counts=True)
        added = {int(h): by_hour[a:a + c] for h, a, c in zip(new_hours, start, new_counts)}
        lists: dict[int, np.ndarray] = {}

        def times(hour: int) -> np.ndarray:
            """The hour's rows as one sorted number of card and time each."""
            if hour not in lists:
                parts = [of[added[hour]] * SPAN + (us[added[hour]] - hour * HOUR_US)] if hour in added else []
                if hour in held:
                    parts.append(np.repeat(held[hour][0], held[hour][1]) * SPAN + (_long(self.times_of.getValue((hour,))[0]) - hour * HOUR_US))
                lists[hour] = np.sort(np.concatenate(parts)) if parts else NONE
            return lists[hour]

        def counts(hour: int) -> np.ndarray:
            c = np.bincount(of[added[hour]], minlength=n_cards) if hour in added else np.zeros(n_cards, np.int64)
            if hour in held:
                c[held[hour][0]] += held[hour][1]
            return c

        recent = np.empty(len(us), np.int64)
        whole, window = np.zeros(n_cards, np.int64), {}  # the rows of the 23 hours before, moved on from hour to hour
        for h in new_hours.tolist():
            inside = range(h - DAY_HOURS + 1, h)
            for g in [g for g in window if g not in inside]:
                whole -= window.pop(g)
            for g in inside:
                if g not in window and (g in held or g in added):
                    window[g] = counts(g)
                    whole += window[g]
            at = added[h]
            c, t = of[at], us[at] - h * HOUR_US
            own, edge = times(h), times(h - DAY_HOURS)
            recent[at] = (whole[c] + np.searchsorted(own, c * SPAN + t, "right") - np.searchsorted(own, c * SPAN, "left")
                          + np.searchsorted(edge, (c + 1) * SPAN, "left") - np.searchsorted(edge, c * SPAN + t, "left"))
        for h in added:
            expire = (h + 1 + DAY_HOURS) * (HOUR_US // 1000)
            if expire > timerValues.getCurrentWatermarkInMs():
                c, t = np.divmod(times(h), SPAN)
                whose, rows_of = np.unique(c, return_counts=True)
                self.times_of.updateValue((h,), ((t + h * HOUR_US).tolist(),))
                self.count_of.updateValue((h,), (cards[whose].tolist(), rows_of.tolist()))
                if h not in held:
                    self.handle.registerTimer(expire)
        end = first + size - 1
        move = ~known[spot] | (us[end] >= last_us[spot])
        last_us[spot[move]], last_amount[spot[move]] = us[end[move]], amount[end[move]]
        n[spot] += size
        cents[spot] += np.add.reduceat(own_cents, first)
        self.last.update(tuple(x.tolist() for x in (cards, last_us, last_amount, n, cents)))
        yield pd.DataFrame({"transaction_id": frame["transaction_id"].to_numpy(), "card_number": card, "minutes_since_last": minutes,
                            "amount_diff": amount - prev_amount, "history_mean_amount": history, "tx_count_24h": recent})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        hour = expiredTimerInfo.getExpiryTimeInMs() // (HOUR_US // 1000) - 1 - DAY_HOURS
        for state in (self.count_of, self.times_of):
            if state.containsKey((hour,)):
                state.removeKey((hour,))
        return iter([])

    def close(self) -> None:
        pass


def card_state_features(stream: DataFrame, delay: str = "1 hour", groups: int = 64) -> DataFrame:
    """Per arriving row the card's features. Rows in order over the micro-batches get the batch WIN3/WIN1/AGG24/WIN5 values; rows of
    one batch may come in any order. Late rows within ``delay`` have exact 24 h counts, and no previous row; rows without a card are a card
    of their own, rows without a time take no part. The cards are dealt over ``groups`` states (``card_groups``). The session's state store
    is set to the one such processors need."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # frames are made of named tuples: no column name may begin with an underscore, and no key be null
    card = F.coalesce("card_number", F.lit(NO_CARD))
    s = (stream.withColumn("us", F.unix_micros("transaction_ts")).where("us IS NOT NULL").withWatermark("transaction_ts", delay)
               .select("transaction_id", card.alias("card_number"), "amount", "transaction_ts", "us",
                       card_group(F.col("card_number"), groups).alias("card_group")))
    out = s.groupBy("card_group").transformWithStateInPandas(
        statefulProcessor=CardState(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
    return out.withColumn("card_number", F.nullif("card_number", F.lit(NO_CARD)))
