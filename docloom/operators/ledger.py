"""Keyed usage, cooldowns and ranking over an event table, in batch.

``events``: key, model, at (timestamp), ok, class, latency_ms, reopen_after_ms, scope, seq (orders equal times).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the score, defaults for unknown keys, server backoff steps in ms.
WEIGHTS = (0.40, 0.25, 0.20, 0.15)
UNKNOWN_SCORE, UNKNOWN_RATE, UNKNOWN_SPEED = 0.75, 0.8, 0.6
BACKOFF_MS = (30_000, 60_000, 120_000, 300_000)
DEFAULT_COOLDOWN_MS, MODEL_GONE_MS = 60_000, 21_600_000


def over_limit(events: DataFrame, key: str, ts: str, width: str, limit: int) -> DataFrame:
    """Tumbling windows per key with the number of requests that a limit turns away."""
    n = F.count("*")
    counted = events.groupBy(F.col(key), F.date_trunc(width, F.col(ts)).alias("window_start")).agg(n.alias("n"))
    return counted.withColumn("blocked", F.greatest(F.col("n") - limit, F.lit(0))).filter("blocked > 0")


def score(success: Column, fail: Column, latency: Column, requests: Column, idle_minutes: Column) -> Column:
    """0.40 success rate, 0.25 speed, 0.20 little use today, 0.15 idle time; 0.75 for a key without a record."""
    total = success + fail
    rate = F.when(total == 0, F.lit(UNKNOWN_RATE)).otherwise(success / total)
    speed = F.when(latency > 0, F.least(F.lit(1.0), 60000 / latency)).otherwise(F.lit(UNKNOWN_SPEED))
    parts = (rate, speed, 1 / (1 + requests / 10), F.least(F.lit(1.0), idle_minutes / 10))
    return F.coalesce(sum((w * p for w, p in zip(WEIGHTS, parts, strict=True)), F.lit(0.0)), F.lit(UNKNOWN_SCORE))


def classify_error(status: Column, body: Column, timeout: Column, fails: Column, midnight_ms: Column) -> Column:
    """HTTP status and JSON body to (class, reopen_after_ms, scope, detail); the first rule that holds decides."""
    is_json = F.try_parse_json(body).isNotNull() if hasattr(F, "try_parse_json") else F.lit(True)
    message = F.coalesce(F.when(is_json, F.coalesce(F.get_json_object(body, "$.error.message"), F.lit(""))).otherwise(body), F.lit(""))
    details = F.coalesce(F.from_json(F.get_json_object(body, "$.error.details"), "array<struct<`@type`:string,retryDelay:string,violations:array<struct<quotaId:string>>>>"), F.array().cast("array<struct<`@type`:string,retryDelay:string,violations:array<struct<quotaId:string>>>>"))
    of = lambda kind: F.get(F.filter(details, lambda d: F.coalesce(d["@type"], F.lit("")).contains(kind)), F.lit(0))
    quota = F.coalesce(F.get(of("QuotaFailure")["violations"], F.lit(0))["quotaId"], F.lit(""))
    from docloom.functions.calc import retry_delay_ms

    wait = F.coalesce(retry_delay_ms(of("RetryInfo")["retryDelay"]), F.lit(0))
    short = F.substring(message, 1, 200)
    http = F.substring(F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" "), message), 1, 200)
    made = lambda kind, after, scope, detail: F.struct(F.lit(kind).alias("class"), F.lit(after).cast("long").alias("reopen_after_ms") if not isinstance(after, Column) else after.cast("long").alias("reopen_after_ms"), F.lit(scope).alias("scope"), detail.alias("detail"))
    daily = quota.rlike("(?i)PerDay") | message.rlike("(?i)per day|daily")
    gone = message.rlike(r"""(?i)models/[^\s'"]+ is not found|is not found for API version|not supported for (generateContent|streamGenerateContent)|no longer available""")
    bad_key = message.rlike("(?i)API_KEY_INVALID|API key not valid|PERMISSION_DENIED")
    step = F.get(F.array(*(F.lit(x) for x in BACKOFF_MS)), F.least(F.coalesce(fails, F.lit(0)), F.lit(len(BACKOFF_MS) - 1)))
    return (
        F.when((status == 429) & daily, made("RPD", midnight_ms, "model", F.coalesce(F.nullif(quota, F.lit("")), F.lit("daily quota exhausted"))))
        .when(status == 429, made("RPM", F.when(wait > 0, wait).otherwise(DEFAULT_COOLDOWN_MS), "model", F.coalesce(F.nullif(quota, F.lit("")), F.lit("per-minute rate limit"))))
        .when(timeout, made("TIMEOUT", 0, "model", F.coalesce(F.nullif(short, F.lit("")), F.lit("attempt timeout"))))
        .when((status == 404) & gone, made("MODEL_NA", MODEL_GONE_MS, "model", short))
        .when(status == 404, made("UNKNOWN", DEFAULT_COOLDOWN_MS, "model", http))
        .when((status == 403) | bad_key, made("INVALID", None, "key", F.lit("key invalid or forbidden")))
        .when(message.rlike("(?i)user location is not supported"), made("LOCATION", 0, "model", short))
        .when(status == 400, made("FATAL_INPUT", 0, "model", short))
        .when((status == 0) | (status >= 500), made("SERVER", step, "model", http))
        .otherwise(made("UNKNOWN", DEFAULT_COOLDOWN_MS, "model", http))
    )


def streaks(events: DataFrame, key: str, order: list[str], failed: Column, skip: Column | None = None) -> DataFrame:
    """The longest run of failures of each key; rows for which ``skip`` holds neither count nor end a run."""
    rows = events if skip is None else events.filter(~skip)
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("bad", failed.cast("int")).withColumn("run", F.sum(1 - F.col("bad")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run").agg(F.sum("bad").alias("n")).groupBy(key).agg(F.max("n").alias("longest"))


def states(events: DataFrame, now: Column) -> DataFrame:
    """Per key and Pacific day: counts, failures by class, rounded running latency, current streak and reopening.

    The latency is folded in order, rounded at each step, over the latencies of one key and day.
    """
    from docloom.functions.calc import half_up, pacific_day

    day = events.withColumn("day", pacific_day(F.col("at")))
    last = day.groupBy("key").agg(F.max("day").alias("day"))
    today = day.join(last, ["key", "day"])
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("at", "seq", c)))), lambda s: s[c])
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("v"))
    running = F.aggregate(ordered("latency_ms"), zero, lambda a, x: F.struct((a["n"] + 1).alias("n"), F.when(a["n"] == 0, x.cast("double")).otherwise(half_up((a["v"] * a["n"] + x) / (a["n"] + 1)).cast("double")).alias("v")), lambda a: a["v"])
    per = today.groupBy("key", "day").agg(F.count("*").alias("requests"), F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("fail"), F.max("at").alias("last_used_at"), running.alias("avg_latency_ms"))
    classes = today.filter("NOT ok").groupBy("key", "class").count().groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", F.col("count").cast("int").alias("n"))))).alias("by_reason"))
    w = Window.partitionBy("key").orderBy("at", "seq")
    tail = events.filter("NOT coalesce(class = 'TIMEOUT', false)").withColumn("reset", (F.coalesce(F.col("class"), F.lit("")) != "SERVER").cast("int"))
    tail = tail.withColumn("run", F.sum("reset").over(w)).groupBy("key", "run").agg(F.sum(1 - F.col("reset")).alias("fail_streak")).groupBy("key").agg(F.max_by("fail_streak", "run").alias("fail_streak"))
    models = events.groupBy("key", "model").agg(F.max_by(F.struct((F.unix_millis("at") + F.coalesce("reopen_after_ms", F.lit(0))).alias("reopen_ms"), F.col("class").alias("reason"), "ok", "scope"), F.struct("at", "seq")).alias("last"))
    invalid = events.filter("class = 'INVALID'").select("key").distinct().withColumn("invalid", F.lit(True))
    nested = models.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.struct(F.when(F.col("last.ok"), F.lit(0).cast("long")).otherwise(F.col("last.reopen_ms")).alias("reopen_ms"), F.when(~F.col("last.ok"), F.col("last.reason")).alias("reason")))))).alias("models"))
    out = per.join(classes, "key", "left").join(tail, "key", "left").join(nested, "key", "left").join(invalid, "key", "left")
    return out.withColumn("state", F.when(F.col("invalid"), "INVALID").otherwise("READY")).drop("invalid").withColumn("score", score(F.col("success"), F.col("fail"), F.coalesce("avg_latency_ms", F.lit(0.0)), F.col("requests"), (F.unix_millis(now) - F.unix_millis("last_used_at")) / 60000))


def available(state: Column, key_reopen_ms: Column, model_reopen_ms: Column, now_ms: Column) -> Column:
    """An unknown key is available; an invalid one never; others once key and model have reopened."""
    return ~F.coalesce(state == "INVALID", F.lit(False)) & (F.coalesce(key_reopen_ms, F.lit(0)) <= now_ms) & (F.coalesce(model_reopen_ms, F.lit(0)) <= now_ms)


def ranked(usable: DataFrame, partition: str = "model") -> DataFrame:
    """Keys of each model by (streak of 2 or more, last use, score downwards, idx)."""
    w = Window.partitionBy(partition).orderBy((F.coalesce("fail_streak", F.lit(0)) >= 2).cast("int"), F.coalesce("last_used_ms", F.lit(0)), F.desc("score"), "idx")
    return usable.withColumn("rank", F.row_number().over(w))


def attempt_plan(ranks: DataFrame, models: DataFrame, most: int = 8) -> DataFrame:
    """The first ceil(most / number of models) keys of each model, models in order, ``most`` in all."""
    count = models.select(F.count("*").alias("models"))
    plan = ranks.join(models, "model").join(F.broadcast(count)).filter(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.lit(most) / F.col("models"))))
    return plan.orderBy("model_order", "rank").limit(most).drop("models")


def skip_model(plan: DataFrame, at: int, model: str) -> DataFrame:
    """What is left of a plan (step, model, ...) after step ``at`` once a model is given up: its direct followers go."""
    rest = plan.filter(F.col("step") > at)
    w = Window.orderBy("step")
    return rest.withColumn("left", F.max((F.col("model") != model).cast("int")).over(w)).filter("left = 1").drop("left")


def status(states_: DataFrame, now_ms: int) -> DataFrame:
    """Per key: READY, COOLING or INVALID and the seconds to wait for each model."""
    waits = F.transform_values("models", lambda _, m: F.struct(F.when(m["reopen_ms"] > now_ms, F.ceil((m["reopen_ms"] - now_ms) / 1000)).otherwise(F.lit(0)).cast("long").alias("reopen_in_sec"), m["reason"].alias("reason")))
    out = states_.withColumn("waits", waits)
    cooling = (F.size("waits") > 0) & F.forall(F.map_values("waits"), lambda m: m["reopen_in_sec"] > 0)
    return out.withColumn("shown", F.when(F.col("state") == "INVALID", "INVALID").when(cooling, "COOLING").otherwise("READY"))


def soonest(status_: DataFrame) -> DataFrame:
    """The smallest positive countdown over all keys and models; 0 if nothing cools."""
    each = status_.select(F.explode(F.map_values("waits")).alias("w"))
    return each.agg(F.coalesce(F.min(F.when(F.col("w.reopen_in_sec") > 0, F.col("w.reopen_in_sec"))), F.lit(0).cast("long")).alias("wait_sec"))


def migrate(entries: DataFrame) -> DataFrame:
    """Version 1 model rows (key, model, reopen_ms, reason, fail_streak, version): stale reasons are cleared."""
    stale = (F.col("version") < 2) & F.col("reason").isin("MODEL_NA", "SERVER")
    return entries.select("key", "model", F.when(stale, F.lit(0).cast("long")).otherwise(F.col("reopen_ms")).alias("reopen_ms"), F.when(~stale, F.col("reason")).alias("reason"), F.when(F.col("version") < 2, F.lit(0).cast("long")).otherwise(F.col("fail_streak")).alias("fail_streak"), F.greatest(F.col("version"), F.lit(2)).alias("version"))


def rotation(keys: DataFrame, offset: int, with_cooling: bool = False) -> DataFrame:
    """Valid keys (key, idx, invalid, cooling): active ones first from a round-robin offset; cooling ones on demand or if none is active."""
    valid = keys.filter("NOT invalid")
    w = Window.partitionBy("cooling").orderBy("idx")
    placed = valid.withColumn("place", F.row_number().over(w) - 1).join(F.broadcast(valid.agg(F.count_if(~F.col("cooling")).alias("active"))))
    turned = placed.withColumn("turn", F.when(F.col("cooling") | (F.col("active") == 0), F.col("place")).otherwise(F.pmod(F.col("place") - offset, F.col("active"))))
    return turned.filter(~F.col("cooling") | F.lit(with_cooling) | (F.col("active") == 0)).orderBy("cooling", "turn").select("key", "cooling", "turn")


def next_offset(offset: Column, active: Column) -> Column:
    return F.when(active > 0, F.pmod(offset + 1, active)).otherwise(F.lit(0))
