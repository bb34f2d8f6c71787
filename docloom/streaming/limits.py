"""Streams of requests: tumbling limits with watermarks, and keyed state with cooldowns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "requests long, success long, fail long, streak long, latency double, day string, reopen_ms long, reason string, invalid boolean, last_ms long"
OUT = "key string, requests long, success long, fail long, fail_streak long, avg_latency_ms double, state string, reopen_ms long, reason string, last_used_ms long"


def limited(events: DataFrame, key: str, ts: str, width: str, limit: int, late: str = "2 minutes") -> DataFrame:
    """Requests per key and fixed window beyond a limit; windows close when the watermark passes them."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width), F.col(key)).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), key, "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("blocked"))


def fold(state: list, row) -> list:
    """One event into (requests, success, fail, streak, latency, day, reopen_ms, reason, invalid, last_ms).

    Counters start anew each Pacific day, and a daily cooldown ends with it; the mean latency is rounded at
    every step; timeouts leave the streak alone; an invalid key stays so.
    """
    requests, success, fail, streak, latency, day, reopen, reason, invalid, _ = state
    if row.day != day:
        requests = success = fail = 0
        day = row.day
        if reason == "RPD":
            reopen, reason = 0, None
    requests += 1
    if row.ok:
        success += 1
        streak, reopen, reason, invalid = 0, 0, None, False
        latency = float(row.latency_ms) if success == 1 else float(math.floor((latency * (success - 1) + row.latency_ms) / success + 0.5))
    else:
        fail += 1
        if row.cls != "TIMEOUT":
            streak = streak + 1 if row.cls == "SERVER" else 0
        if row.cls == "INVALID":
            invalid, reason = True, "INVALID"
        elif row.reopen_after_ms and row.reopen_after_ms > 0:
            reopen, reason = int(row.at_ms + row.reopen_after_ms), row.cls
    return [requests, success, fail, streak, latency, day, reopen, reason, invalid, int(row.at_ms)]


EMPTY = [0, 0, 0, 0, 0.0, "", 0, None, False, 0]


def _shown(key: str, s: list) -> tuple:
    return (key, s[0], s[1], s[2], s[3], s[4], "INVALID" if s[8] else "READY", s[6], s[7], s[9])


def ledger_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The state of each key after its events (key, day, at_ms, seq, ok, cls, latency_ms, reopen_after_ms), as a stream of updates.

    Events of one key within a micro-batch are folded in order of (at_ms, seq). With ``idle_ms`` a key that has had none for so
    long loses its state; that is for streams that run on, as such a query never ends by itself.
    """
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get) if state.exists else list(EMPTY)
        rows = pd.concat(list(batches)).sort_values(["at_ms", "seq"])
        for row in rows.itertuples():
            held = fold(held, row)
        state.update(tuple(held))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([_shown(key[0], held)], columns=[c.split()[0] for c in OUT.split(", ")])

    return events.groupBy("key").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def ledger_batch(events: DataFrame) -> DataFrame:
    """The same fold over a whole table, one group per key."""
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        held = list(EMPTY)
        for row in df.sort_values(["at_ms", "seq"]).itertuples():
            held = fold(held, row)
        return pd.DataFrame([_shown(key[0], held)], columns=[c.split()[0] for c in OUT.split(", ")])

    return events.groupBy("key").applyInPandas(run, OUT)


def with_retries(chunks: DataFrame, call, tries: int = 3, final: tuple[str, ...] = ("FATAL_INPUT", "INVALID")) -> DataFrame:
    """call(payload) per chunk (id, payload) with retries; classes in ``final`` are not tried again; failures stay as rows.

    ``call`` returns a text or raises an error whose ``kind`` attribute is its class.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for i, payload in zip(df["id"], df["payload"], strict=True):
                text = kind = None
                n = 0
                while n < tries and text is None and kind not in final:
                    n += 1
                    try:
                        text, kind = call(payload), None
                    except Exception as e:  # noqa: BLE001  the class of the failure is the result
                        kind = getattr(e, "kind", "UNKNOWN")
                out.append((i, text, kind, n))
            yield pd.DataFrame(out, columns=["id", "text", "failure", "tries"])

    return chunks.select("id", "payload").mapInPandas(run, "id long, text string, failure string, tries int")
