"""Keyed state with event-time timers: counters that turn with the day and cooldowns that end, also for keys that fall silent."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.functions import calc

COUNTS = "day string, turns_ms long, requests long, success long, fail long, streak long, last_ms long"
OUT = "key string, at_ms long, by_timer boolean, day string, requests long, success long, fail long, fail_streak long, cooling array<string>"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Ledger(StatefulProcessor):
    """Per key: counters of the Pacific day of its last event, its streak of server failures, and for each model until when it cools.

    Two kinds of timers: one at the next Pacific midnight sets the counters back, one at a cooldown's end opens the model again. A micro-batch
    folds a key's events by whole columns. State of a key that has had no event for ``idle_ms`` expires.
    """

    def __init__(self, idle_ms: int | None = None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", COUNTS, self.idle_ms)
        self.cooling = handle.getMapState("cooling", "model string", "until_ms long", self.idle_ms)

    def _row(self, key: tuple, at: int, by_timer: bool) -> pd.DataFrame:
        day, _, requests, success, fail, streak, _ = self.counts.get()
        models = sorted(m[0] for m in self.cooling.keys())
        return pd.DataFrame([(key[0], at, by_timer, day, requests, success, fail, streak, models)], columns=[c.split()[0] for c in OUT.split(", ")])

    def _wake(self, wanted: int, old: int | None) -> None:
        """One timer at ``wanted`` in the place of an old one; timers of a key that fall together are one."""
        if old and old != wanted and old not in self._others():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(wanted)

    def _others(self) -> set[int]:
        return {v[0] for v in self.cooling.values()}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        df = pd.concat(list(rows)).sort_values(["at_ms", "seq"], kind="stable")
        old = self.counts.get() if self.counts.exists() else None
        if old and old[6] is not None:  # what comes late counts with the day that it belongs to, or not at all
            df = df[df["day"] >= old[0]]
            if df.empty:
                return
        last = df.iloc[-1]
        today = df[df["day"] == last["day"]]
        same = old is not None and old[0] == last["day"]
        base = list(old[2:5]) if same else [0, 0, 0]
        ok = int(today["ok"].sum())
        after = df[df["cls"].ne("TIMEOUT")]
        ends = after[after["ok"] | after["cls"].ne("SERVER")]
        run = after if ends.empty else after.loc[after.index[list(after.index).index(ends.index[-1]) + 1 :]]
        streak = len(run) + (old[5] if ends.empty and old else 0)
        turns = int(last["turns_ms"])
        before = old[1] if old else None
        cools = df[df["reopen_ms"].notna()].groupby("model")["reopen_ms"].last()
        opened = df[df["ok"]].groupby("model")["at_ms"].last()
        failed = df[~df["ok"]].groupby("model")["at_ms"].last()
        for model, at in opened.items():  # a success ends the cooldown unless a failure follows
            if self.cooling.containsKey((model,)) and at >= failed.get(model, -1):
                until = self.cooling.getValue((model,))[0]
                self.cooling.removeKey((model,))
                if until not in self._others() and until != before:
                    self.handle.deleteTimer(until)
        now = timerValues.getCurrentWatermarkInMs()
        for model, until in cools.items():
            if failed.get(model, -1) >= opened.get(model, -1) and until > now:
                self.cooling.updateValue((model,), (int(until),))
                self.handle.registerTimer(int(until))
        self.counts.update((last["day"], turns, base[0] + len(today), base[1] + ok, base[2] + len(today) - ok, streak, int(last["at_ms"])))
        self._wake(turns, before)
        yield self._row(key, int(last["at_ms"]), False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.counts.exists():
            return
        for model in [m for m in self.cooling.keys() if self.cooling.getValue(m)[0] <= at]:
            self.cooling.removeKey(model)
        held = list(self.counts.get())
        if held[1] <= at:
            held[2:5] = [0, 0, 0]
            self.counts.update(tuple(held))
        yield self._row(key, at, True)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State with timers needs this store; the session's own choice comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def ledger(events: DataFrame, late: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """Updates of each key's ledger from a stream (key, ts, seq, model, ok, cls, reopen_after_ms); the query is to be started within ``rocks``."""
    at = F.unix_millis("ts")
    day = calc.pacific_day(F.col("ts"))
    turns = F.unix_millis(F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), "America/Los_Angeles"))
    rows = events.withWatermark("ts", late).select("key", "ts", "seq", "model", "ok", "cls", at.alias("at_ms"), day.cast("string").alias("day"), turns.alias("turns_ms"), F.when(~F.col("ok") & (F.col("reopen_after_ms") > 0), at + F.col("reopen_after_ms")).alias("reopen_ms"))
    return rows.groupBy("key").transformWithStateInPandas(Ledger(idle_ms), OUT, "Update", "EventTime")
