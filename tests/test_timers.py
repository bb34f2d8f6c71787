"""State with timers: silent keys turn their day and end their cooldowns; a query that stops goes on from its checkpoint."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from docloom import storage
from docloom.plans import catalogue
from docloom.streaming import timers
from pyspark.sql import functions as F

UTC = dt.UTC
START = dt.datetime(2024, 3, 8, 20, tzinfo=UTC)
SCHEMA = "key string, ts timestamp, seq long, model string, ok boolean, cls string, reopen_after_ms long"


def plain(rows, now):
    """The ledger of each key at a time, event by event."""
    out = {}
    for key in {r[0] for r in rows}:
        day, counts, streak, cooling = None, [0, 0, 0], 0, {}
        for _, ts, _, model, ok, cls, reopen in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            mine = ts.astimezone(ZoneInfo("America/Los_Angeles")).date()
            if mine != day:
                day, counts = mine, [0, 0, 0]
            counts = [counts[0] + 1, counts[1] + ok, counts[2] + (not ok)]
            streak = 0 if ok else streak if cls == "TIMEOUT" else streak + 1 if cls == "SERVER" else 0
            if ok:
                cooling.pop(model, None)
            elif reopen:
                cooling[model] = ts + dt.timedelta(milliseconds=reopen)
        midnight = dt.datetime.combine(day + dt.timedelta(days=1), dt.time(), ZoneInfo("America/Los_Angeles"))
        if midnight <= now:
            counts = [0, 0, 0]
        out[key] = (*counts, streak, tuple(sorted(m for m, until in cooling.items() if until > now)))
    return out


def events(seed, n=300):
    """Keys that fall silent early, over the night in which the clocks change."""
    r, rows, at = random.Random(seed), [], START
    for i in range(n):
        at += dt.timedelta(minutes=r.randrange(1, 25))
        key = f"k{r.randrange(3 + 6 * i // n)}" if i > n // 3 else f"early{r.randrange(3)}"
        ok = r.random() < 0.4
        rows.append((key, at, i, r.choice("ab"), ok, None if ok else r.choice(["SERVER", "TIMEOUT", "FATAL"]), None if ok else r.choice([0, 60_000, 7_200_000, 90_000_000])))
    return rows


def run(spark, folder, checkpoint, out):
    def keep(batch, number):
        batch.withColumn("number", F.lit(number)).write.mode("append").parquet(out)

    with timers.rocks(spark):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        timers.ledger(stream).writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()


def last(spark, out):
    rows = spark.read.parquet(out).groupBy("key").agg(F.max_by(F.struct("requests", "success", "fail", "fail_streak", "cooling"), F.struct("number", "at_ms", "by_timer")).alias("s")).collect()
    return {r.key: (r.s.requests, r.s.success, r.s.fail, r.s.fail_streak, tuple(r.s.cooling)) for r in rows}


@pytest.mark.parametrize("restart", [False, True])
def test_silent_keys_and_restarts(spark, tmp_path, restart):
    rows = events(7)
    folder, checkpoint, out = (f"file://{tmp_path}/{x}" for x in ("in", "checkpoint", "out"))
    cuts = [rows[i : i + 75] for i in range(0, len(rows), 75)]
    for k, part in enumerate(cuts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        if restart or k == len(cuts) - 1:
            run(spark, folder, checkpoint, out)
    now = max(r[1] for r in rows) - dt.timedelta(minutes=10)
    got = last(spark, out)
    assert got == plain(rows, now)
    assert all(got[k][:3] == (0, 0, 0) for k in got if k.startswith("early"))
    assert spark.read.parquet(out).filter("by_timer AND key LIKE 'early%'").count() >= 3


def test_query_turns_days_and_ends_cooldowns(spark, sf):
    rows = catalogue.QUERIES["ledger_timers"](spark, sf).collect()
    assert {r.day_turned for r in rows} == {True, False}


def test_the_session_keeps_its_store(spark):
    before = spark.conf.get(timers._PROVIDER)
    with pytest.raises(ZeroDivisionError), timers.rocks(spark):
        assert "RocksDB" in spark.conf.get(timers._PROVIDER)
        1 / 0  # noqa: B018
    assert spark.conf.get(timers._PROVIDER) == before
    assert storage.shared_dir(spark)
