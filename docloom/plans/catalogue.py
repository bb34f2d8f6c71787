"""The operators applied to the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import storage
from docloom.functions import calc, text
from docloom.operators import documents, ledger, markup, medians, order, patterns, relational, windows
from docloom.parse import maths, papers, transcode
from docloom.plans import classify
from docloom.streaming import kept, limits, timers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LAST = "(SELECT max(ts) FROM events)"


@query("SELECT user_id, date_trunc('minute', ts) AS window_start, count(*) AS n, count(*) - 1 AS blocked FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit_minute(spark, d):
    return ledger.over_limit(table(spark, d, "events"), "user_id", "ts", "minute", 1)


@query("SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS n, count(*) - 3 AS blocked FROM events GROUP BY ALL HAVING count(*) > 3")
def daily_cap_blocked(spark, d):
    return ledger.over_limit(table(spark, d, "events"), "user_id", "ts", "day", 3)


_RANKED = f"""
WITH s AS (SELECT event_type AS model, user_id AS key, count(*) FILTER (value >= 50) AS ok, count(*) FILTER (value < 50) AS bad, avg(value) * 1000 AS lat, epoch_ms(max(ts)) AS last_used_ms FROM events GROUP BY ALL),
n AS (SELECT epoch_ms(max(ts)) AS now FROM events),
r AS (SELECT s.*, 0.40 * ok / (ok + bad) + 0.25 * CASE WHEN lat > 0 THEN least(1, 60000 / lat) ELSE 0.6 END + 0.20 * 1 / (1 + (ok + bad) / 10) + 0.15 * least(1, (now - last_used_ms) / 60000 / 10) AS score FROM s, n),
k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY last_used_ms, score DESC, key) AS rank FROM r)"""


def _ranks(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy(F.col("event_type").alias("model"), F.col("user_id").alias("key")).agg(F.count_if(F.col("value") >= 50).alias("ok"), F.count_if(F.col("value") < 50).alias("bad"), (F.avg("value") * 1000).alias("lat"), F.unix_millis(F.max("ts").cast("timestamp")).alias("last_used_ms"))
    s = s.join(F.broadcast(e.agg(F.unix_millis(F.max("ts").cast("timestamp")).alias("now"))))
    s = s.withColumn("score", ledger.score(F.col("ok"), F.col("bad"), F.col("lat"), F.col("ok") + F.col("bad"), (F.col("now") - F.col("last_used_ms")) / 60000))
    return ledger.ranked(s.withColumn("fail_streak", F.lit(0)).withColumn("idx", F.col("key")))


@query(_RANKED + " SELECT model, key, rank, round(score, 9) AS score FROM k WHERE rank <= 3")
def key_rank_topk(spark, d):
    """Usage per key, its score, and the three keys of each model to try first."""
    return _ranks(spark, d).filter("rank <= 3").select("model", "key", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query(_RANKED + ", m AS (SELECT model, row_number() OVER (ORDER BY model) AS o FROM (SELECT DISTINCT model FROM k)) SELECT model, key, CAST(rank AS BIGINT) AS rank FROM k JOIN m USING (model) WHERE rank <= ceil(8 / (SELECT count(*) FROM m)) ORDER BY o, rank LIMIT 8")
def attempt_plan(spark, d):
    ranks = _ranks(spark, d)
    models = spark.createDataFrame([(m, i) for i, m in enumerate(("click", "error", "purchase", "signup", "view"))], "model string, model_order int")
    return ledger.attempt_plan(ranks, models, 8).select("model", "key", F.col("rank").cast("long").alias("rank"))


@query("""WITH a AS (SELECT user_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events WHERE event_type <> 'signup')
SELECT user_id, max(n) AS longest FROM (SELECT user_id, run, count(*) FILTER (bad) AS n FROM a GROUP BY ALL) GROUP BY user_id""")
def fail_streak_max(spark, d):
    """signup stands for a timeout, which neither counts nor ends a streak."""
    return ledger.streaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "signup")


@query(f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE epoch({LAST}) - epoch(ts) <= 86400) WHERE k <= 20".replace("epoch(ts)", "floor(epoch(ts))").replace(f"epoch({LAST})", f"floor(epoch({LAST}))"))
def history_prune(spark, d):
    e = table(spark, d, "events")
    e = e.join(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return windows.retained(e, ["user_id"], "ts", F.col("now"), 86400, 20, "event_id").select("user_id", "event_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def history_upsert(spark, d):
    e = table(spark, d, "events")
    return windows.upserted(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'fixed' ELSE event_type END AS event_type, value FROM events")
def record_patch(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return windows.patched(e, e.filter("event_type = 'error'").select("event_id", F.lit("fixed").alias("event_type")), "event_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE NOT (event_type = 'view' AND coalesce(p = 'view', false))")
def event_log_quiet(spark, d):
    return windows.without_repeats(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "event_type", "view").select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 30")
def log_keep_last(spark, d):
    return windows.newest(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 30).select("user_id", "event_id")


@query("SELECT concat_ws('|', 'v1', 'template', CASE WHEN lang = 'en' THEN NULL ELSE lang END, sha256(text)) AS cache_key, count(*) AS n FROM documents GROUP BY 1")
def cache_key_dedup(spark, d):
    docs = table(spark, d, "documents")
    key = relational.cache_key(F.lit("v1"), F.lit(""), F.when(F.col("lang") == "en", " ").otherwise(F.col("lang")), relational.content_hash(F.array("text")))
    return docs.groupBy(key.alias("cache_key")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(sha256(text) || '|' || sha256(lang)) AS hash FROM documents")
def content_hash_parts(spark, d):
    return table(spark, d, "documents").select("doc_id", relational.content_hash(F.array("text", "lang")).alias("hash"))


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'de')")
def cache_misses(spark, d):
    docs = table(spark, d, "documents").withColumn("h", relational.content_hash(F.array("text")))
    return docs.join(docs.filter("lang = 'de'").select("h"), "h", "left_anti").select("doc_id")


@query("""WITH h AS (SELECT event_type AS cache_key, value, ts, event_id FROM events WHERE value >= 10),
b AS (SELECT cache_key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ts DESC, event_id DESC) AS k FROM h) WHERE k = 1)
SELECT c.cache_key, CASE WHEN c.cache_key = 'view' THEN 'session' WHEN b.cache_key IS NOT NULL THEN 'history' END AS source, CASE WHEN c.cache_key = 'view' THEN 'now' ELSE CAST(b.event_id AS VARCHAR) END AS payload
FROM (SELECT DISTINCT event_type AS cache_key FROM events) c LEFT JOIN b ON b.cache_key = c.cache_key""")
def cache_probe(spark, d):
    e = table(spark, d, "events")
    row = lambda df: df.select("cache_key", "payload", "at", "id")
    session = row(e.filter("event_type = 'view'").select(F.col("event_type").alias("cache_key"), F.lit("now").alias("payload"), F.col("ts").alias("at"), F.col("event_id").alias("id")))
    history = row(e.select(F.col("event_type").alias("cache_key"), F.when(F.col("value") >= 10, F.col("event_id").cast("string")).otherwise(" ").alias("payload"), F.col("ts").alias("at"), F.col("event_id").alias("id")))
    return relational.cached(e.select(F.col("event_type").alias("cache_key")).distinct(), session, history)


@query("""WITH r AS (SELECT *, sum(CASE WHEN event_type IN ('signup') OR event_type NOT IN ('signup', 'click', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM events)
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN first_value(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id, c ORDER BY ts, event_id) END AS owner FROM r""")
def owner_context(spark, d):
    """signup opens a context, click and view stay in it, others close it."""
    e = table(spark, d, "events")
    return windows.carried(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type").isin("click", "view"), "event_id", spread=None).select("event_id", "owner")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS owner FROM events")
def owner_fill(spark, d):
    e = table(spark, d, "events").withColumn("owner", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return windows.filled(e, ["user_id"], ["ts", "event_id"], "owner", spread=None).select("event_id", "owner")


_LINES = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


@query(f"""WITH a AS (SELECT l_orderkey, l_returnflag, row_number() OVER w AS i, lag(l_returnflag) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINES}, l_returnflag)),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> l_returnflag THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY i) AS run FROM a)
SELECT l_orderkey, CAST(run AS BIGINT) AS run, any_value(l_returnflag) AS kind, count(*) AS n FROM b GROUP BY ALL""")
def column_bands_runs(spark, d):
    li = table(spark, d, "lineitem")
    order = [*_LINES.split(", "), "l_returnflag"]
    return windows.value_runs(li, ["l_orderkey"], order, "l_returnflag").groupBy("l_orderkey", "run").agg(F.first("l_returnflag").alias("kind"), F.count("*").alias("n"))


@query("SELECT conv_id, turn, translate(CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS VARCHAR), CASE WHEN role = 'user' THEN '0123456789' ELSE '' END, CASE WHEN role = 'user' THEN '০১২৩৪৫৬৭৮৯' ELSE '' END) AS num FROM conversations")
def section_renumber(spark, d):
    return windows.renumbered(table(spark, d, "conversations"), ["conv_id", "role"], ["turn"], F.col("role") == "user", spread=None).select("conv_id", "turn", "num")


@query("SELECT conv_id, string_agg(coalesce(text, '[chunk ' || turn || ' failed]'), chr(10) || chr(10) ORDER BY turn) AS merged, count(*) AS chunks, count(*) FILTER (text IS NULL) AS failed FROM conversations GROUP BY conv_id")
def chunk_merge(spark, d):
    return windows.merged_chunks(table(spark, d, "conversations"), ["conv_id"], "turn", "text")


@query("SELECT conv_id, any_value(role) AS role, string_agg(text, '' ORDER BY turn) AS text FROM (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS c FROM conversations)) GROUP BY conv_id, run")
def run_merge(spark, d):
    return windows.merged_runs(table(spark, d, "conversations"), ["conv_id"], "turn", ["role"], "text").select("conv_id", "role", "text")


@query("""WITH a AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (trim(text) <> '') AS text FROM a GROUP BY conv_id, r""")
def continuation_rows(spark, d):
    c = table(spark, d, "conversations").withColumn("head", F.when(F.col("role") == "user", "u").otherwise(""))
    return windows.continued(c, ["conv_id"], "turn", "head", ["text"]).select("conv_id", F.nullif("text", F.lit("")).alias("text"))


@query("""WITH a AS (SELECT *, CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) ELSE '' END AS s, CASE WHEN value >= 20 THEN 'x' ELSE '' END AS t FROM events),
b AS (SELECT *, sum(CASE WHEN s <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM a),
c AS (SELECT *, max(CASE WHEN s = '' AND t <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g) AS has, max(CASE WHEN s <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g) AS headed FROM b)
SELECT event_id, CASE WHEN has = 1 AND headed = 1 AND s <> '' THEN 'restart' WHEN has = 1 AND headed = 1 AND s = '' AND t <> '' THEN 'continue' END AS vmerge FROM c""")
def serial_merge(spark, d):
    e = table(spark, d, "events").withColumn("s", F.when(F.col("event_type") == "signup", F.col("event_id").cast("string")).otherwise("")).withColumn("t", F.when(F.col("value") >= 20, "x").otherwise(""))
    return windows.serial_merges(e, ["user_id"], "event_id", "s", "t", spread=None).select("event_id", "vmerge")


@query("SELECT user_id, event_id FROM (SELECT *, min(CASE WHEN event_type <> 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ok FROM events) WHERE ok = 1")
def header_prefix(spark, d):
    return windows.leading(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") != "purchase", spread=None).select("user_id", "event_id")


_ISLANDS = """WITH a AS (SELECT user_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) <= 2 THEN 0 ELSE 1 END AS c FROM events),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT user_id, run, min(value) AS lo, max(value) AS hi, count(*) AS n FROM b GROUP BY ALL)"""


@query(_ISLANDS + " SELECT user_id, CAST(run AS BIGINT) AS run, lo, hi, n FROM c WHERE n >= 2")
def line_islands(spark, d):
    return windows.islands(table(spark, d, "events"), ["user_id"], "value", 2.0, 2, spread=None)


@query(_ISLANDS + " SELECT user_id, hi AS top, bottom FROM (SELECT user_id, hi, lead(lo) OVER (PARTITION BY user_id ORDER BY lo) AS bottom FROM c) WHERE bottom IS NOT NULL")
def rule_bands(spark, d):
    return windows.bands(windows.islands(table(spark, d, "events"), ["user_id"], "value", 2.0), ["user_id"])


@query("SELECT user_id, list_sort(list(value))[CAST(floor(count(*) / 2) AS INT) + 1] AS mid FROM events GROUP BY user_id")
def upper_median(spark, d):
    return medians.upper_medians(table(spark, d, "events"), ["user_id"], "value")


@query("""WITH m AS (SELECT user_id, list_sort(list(value))[CAST(floor(count(*) / 2) AS INT) + 1] AS mid FROM events GROUP BY user_id),
k AS (SELECT e.user_id, event_id, row_number() OVER (PARTITION BY e.user_id ORDER BY abs(value - mid) DESC, event_id) AS k FROM events e JOIN m USING (user_id) WHERE value >= 1.35 * mid OR value <= 0.65 * mid)
SELECT user_id, event_id FROM k WHERE k <= 3""")
def row_suspects(spark, d):
    return relational.suspects(table(spark, d, "events"), ["user_id"], "value", "event_id").select("user_id", "event_id")


@query("""WITH w AS (SELECT lang, source, sum(n_chars) AS w, min(doc_id) AS o FROM documents GROUP BY ALL)
SELECT lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY w DESC, o) AS k FROM w) WHERE k = 1""")
def weighted_mode(spark, d):
    return relational.weighted_mode(table(spark, d, "documents"), ["lang"], "source", "n_chars", "doc_id")


@query("""WITH h AS (SELECT event_type, CAST(least(255, floor(value)) AS BIGINT) AS lev, count(*) AS n FROM events GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS n0, sum(n * lev) OVER w AS s0, sum(n) OVER (PARTITION BY event_type) AS nt, sum(n * lev) OVER (PARTITION BY event_type) AS st FROM h WINDOW w AS (PARTITION BY event_type ORDER BY lev)),
v AS (SELECT *, round(n0 * (nt - n0) * pow(s0 / n0 - (st - s0) / (nt - n0), 2), 3) AS v FROM c WHERE n0 < nt)
SELECT event_type, least(greatest(lev, 0), 255) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, lev) AS k FROM v) WHERE k = 1""")
def otsu_histogram(spark, d):
    e = table(spark, d, "events").withColumn("level", F.least(F.lit(255), F.floor("value")).cast("long"))
    return relational.otsu(e, ["event_type"], "level", 0, 255).select("event_type", F.col("threshold").cast("long").alias("threshold"))


def _refits(rounds: int) -> str:
    """Least squares refitted without large residuals, round by round."""
    steps = "r0 AS (SELECT user_id, value AS x, value * 2 + event_id % 7 AS y FROM events)"
    for k in range(rounds):
        steps += f""", f{k} AS (SELECT user_id, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM r{k} GROUP BY user_id),
o{k} AS (SELECT r{k}.*, abs(y - a * x - b) AS o FROM r{k} JOIN f{k} USING (user_id)),
m{k} AS (SELECT user_id, list_sort(list(o))[CAST(floor(count(*) / 2) AS INT) + 1] AS m FROM o{k} GROUP BY user_id),
r{k + 1} AS (SELECT user_id, x, y FROM o{k} JOIN m{k} USING (user_id) WHERE coalesce(o <= greatest(2, 2.5 * m), true))"""
    return f"WITH {steps} SELECT user_id, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, count(*) AS n FROM r{rounds} GROUP BY user_id HAVING count(*) >= 6"


@query(_refits(4))
def drift_regression(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("value").alias("x"), (F.col("value") * 2 + F.col("event_id") % 7).alias("y"))
    return windows.trimmed_fit(e, ["user_id"], "x", "y", 4).select("user_id", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"), "n")


_GRAMS = "g AS (SELECT item_id AS id, substring(text, CAST(i AS BIGINT), 2) AS g, count(*) AS n FROM benchmark, unnest(range(1, length(text))) AS u(i) GROUP BY ALL), t AS (SELECT id, sum(n) AS t FROM g GROUP BY id)"


@query(f"""WITH {_GRAMS}, c AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
SELECT a, b, round((c / x.t + c / y.t) / 2, 9) AS similarity FROM c JOIN t x ON x.id = a JOIN t y ON y.id = b""")
def bigram_similarity(spark, d):
    g = relational.bigrams(table(spark, d, "benchmark").withColumnRenamed("item_id", "id"), "id", "text")
    return relational.similarity(g, g).filter("a < b").withColumn("similarity", F.round("similarity", 9))


_TURN_GRAMS = """WITH t AS (SELECT conv_id, turn, role, text, conv_id || ':' || turn AS id, length(text) AS l FROM conversations WHERE role IN ('user', 'assistant')),
g AS (SELECT conv_id, id, role, turn, l, CASE WHEN l = 1 THEN text ELSE substring(text, CAST(i AS BIGINT), 2) END AS g, count(*) AS n FROM t, unnest(range(1, greatest(l, 2))) AS u(i) WHERE l > 0 GROUP BY ALL),
s AS (SELECT id, sum(n) AS s FROM g GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS c FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant' AND abs(a.turn - b.turn) <= 1 AND a.g = b.g AND least(a.l, b.l) >= 0.25 * greatest(a.l, b.l) GROUP BY ALL),
p AS (SELECT a, b, (c / x.s + c / y.s) / 2 AS similarity FROM c JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE (c / x.s + c / y.s) / 2 >= 0.6)"""


def _turns(spark, d):
    """(questions, answers): conversations' turns as texts on pages, a turn's number being its page."""
    t = table(spark, d, "conversations").select("conv_id", F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("turn").alias("page"), "text", "role")
    return t.filter("role = 'user'").drop("role"), t.filter("role = 'assistant'").drop("role")


@query(_TURN_GRAMS + " SELECT a, b, round(similarity, 9) AS similarity FROM p")
def similar_turns(spark, d):
    """Questions and answers of one conversation, no more than a turn apart, that share six tenths of their bigrams."""
    return relational.match_candidates(*_turns(spark, d), keys=("conv_id",)).withColumn("similarity", F.round("similarity", 9))


@query()
def matched_turns(spark, d):
    """Those pairs one to one, the most alike first; no SQL takes the best pair again and again, a test does."""
    return relational.matched_texts(*_turns(spark, d), keys=("conv_id",))


@query("""WITH g AS (SELECT lang, substring(text, CAST(i AS BIGINT), 2) AS g, count(*) AS n FROM documents, unnest(range(1, length(text))) AS u(i) GROUP BY ALL), h AS (SELECT lang = 'en' AS en, g, sum(n) AS n FROM g GROUP BY ALL),
j AS (SELECT a.n AS x, b.n AS y FROM (SELECT * FROM h WHERE en) a FULL JOIN (SELECT * FROM h WHERE NOT en) b USING (g))
SELECT CAST(sum(CASE WHEN x IS NULL OR y IS NULL THEN 0 ELSE least(x, y) END) AS BIGINT) AS common, round(common / sum(x), 9) AS recall, round(common / sum(y), 9) AS precision FROM j""")
def text_recall(spark, d):
    """Bigrams of the English documents in those of all other languages."""
    grams = relational.bigrams(table(spark, d, "documents").withColumn("en", F.col("lang") == "en"), "en", "text")
    side = lambda en: grams.filter(F.col("en") == en).select("gram", "n")
    return relational.overlap_counts(side(True), side(False), ["gram"]).select("common", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice * 0.01 + 0.5) AS BIGINT) AS registration, CAST(floor(o_totalprice * 0.015 + 0.5) AS BIGINT) AS stamp, CAST(2 * floor(o_totalprice * 0.03 + 0.5) AS BIGINT) AS taxes, registration + stamp + taxes + 650 AS total FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders)".replace("0.01 ", "0.01::DOUBLE ").replace("0.015 ", "0.015::DOUBLE ").replace("0.03 ", "0.03::DOUBLE "))
def fee_calculator(spark, d):
    fees = calc.deed_fees(F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_orderkey", fees.alias("f")).select("o_orderkey", "f.registration", "f.stamp", (F.col("f.local_tax") + F.col("f.source_tax")).alias("taxes"), F.col("f.total").cast("long").alias("total"))


@query("SELECT o_orderkey, CAST(datesub('month', CAST(o_orderdate AS DATE), DATE '2024-01-15') // 12 AS INT) AS years, CAST(datesub('month', CAST(o_orderdate AS DATE), DATE '2024-01-15') % 12 AS INT) AS months FROM orders")
def age_months(spark, d):
    a = calc.age(F.to_date("o_orderdate"), F.lit("2024-01-15").cast("date"))
    return table(spark, d, "orders").select("o_orderkey", a.alias("a")).select("o_orderkey", "a.years", "a.months")


@query("SELECT p_partkey, printf('%.3f', p_size / 1.65::DOUBLE) AS katha, printf('%.3f', p_size / 33.0::DOUBLE) AS bigha, printf('%.3f', p_size / 100.0::DOUBLE) AS acre FROM part")
def land_units(spark, d):
    return table(spark, d, "part").select("p_partkey", calc.land_units(F.col("p_size")).alias("u")).select("p_partkey", "u.*")


@query("SELECT event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS day, ((CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) + INTERVAL 1 DAY) AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'UTC' AS midnight FROM events")
def pt_day_bucket(spark, d):
    return table(spark, d, "events").select("event_id", calc.pacific_day(F.col("ts")).alias("day"), calc.next_pacific_midnight(F.col("ts")).alias("midnight"))


@query("SELECT c_custkey, CASE WHEN length(c_name) <= 12 THEN c_name[1:4] || '...' ELSE c_name[1:6] || '...' || c_name[-4:] END AS mask, CASE WHEN length(c_mktsegment) <= 12 THEN c_mktsegment[1:4] || '...' END AS short FROM customer")
def mask_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", calc.mask_key(F.col("c_name")).alias("mask"), calc.mask_key(F.col("c_mktsegment")).alias("short"))


@query("""SELECT event_id, CAST(floor(CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN value * 1000 ELSE 0 END + 0.5) AS BIGINT) AS ms FROM (SELECT event_id, CAST(round(value, 1) AS DOUBLE) AS value FROM events)""")
def retry_delay(spark, d):
    v = F.round("value", 1).cast("string")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(v, F.lit("ms"))).when(F.col("event_id") % 3 == 1, F.concat(v, F.lit("s"))).otherwise("soon")
    return table(spark, d, "events").select("event_id", calc.retry_delay_ms(said).alias("ms"))


_BN = "translate(CAST({} AS VARCHAR), '0123456789', '০১২৩৪৫৬৭৮৯')"


@query(f"""SELECT event_id, CASE WHEN s <= 0 THEN '' WHEN s < 60 THEN {_BN.format('s')} || ' সেকেন্ড' WHEN s < 3600 THEN {_BN.format('CAST(ceil(s / 60) AS BIGINT)')} || ' মিনিট'
ELSE {_BN.format('s // 3600')} || ' ঘণ্টা' || CASE WHEN s % 3600 > 0 THEN ' ' || {_BN.format('CAST(ceil(s % 3600 / 60) AS BIGINT)')} || ' মিনিট' ELSE '' END END AS wait FROM (SELECT event_id, CAST(floor(value * 50) AS BIGINT) AS s FROM events)""")
def human_wait(spark, d):
    return table(spark, d, "events").select("event_id", calc.human_wait(F.floor(F.col("value") * 50)).alias("wait"))


@query("SELECT doc_id, translate(text, '0123456789', '০১২৩৪৫৬৭৮৯') AS text FROM documents")
def digits_to_bengali(spark, d):
    return table(spark, d, "documents").select("doc_id", calc.to_bengali_digits(F.col("text")).alias("text"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM documents")
def collapse_newlines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.strip_artifacts(F.col("text")).alias("text"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT 'part' AS source, p_partkey AS id, p_name AS label FROM part WHERE lower(p_name) LIKE '%1%' UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE lower(s_name) LIKE '%1%'")
def two_table_search(spark, d):
    return relational.tagged_search({"part": (table(spark, d, "part"), "p_partkey", "p_name"), "supplier": (table(spark, d, "supplier"), "s_suppkey", "s_name")}, "1")


@query("SELECT p_brand, count(*) AS n, count(*) FILTER (p_size > 25) AS large, count(*) FILTER (lower(p_type) LIKE '%steel%') AS steel FROM part GROUP BY p_brand")
def category_counts(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("large"), F.count_if(F.lower("p_type").contains("steel")).alias("steel"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) AND lower(o_orderstatus) LIKE '%o%'")
def category_search(spark, d):
    o = table(spark, d, "orders")
    marked = o.join(F.broadcast(o.agg(F.min("o_orderpriority").alias("least")))).withColumn("category", F.when(F.col("o_orderpriority") == F.col("least"), "first").otherwise("other"))
    return relational.of_category(marked, "first", "O", ("o_orderstatus",)).select("o_orderkey")


@query("SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '<h([1-6])', 1))) AS INT) AS levels FROM pages")
def coverage_guard(spark, d):
    return table(spark, d, "pages").select("page_id", relational.marked_pages(F.col("html"), "<h([1-6])").alias("levels"))


@query("""WITH s AS (SELECT event_id, user_id, floor(value) AS v, ts FROM events WHERE event_type = 'click'), p AS (SELECT event_id, user_id, floor(value) AS v, ts FROM events WHERE event_type = 'purchase'),
m1 AS (SELECT s.event_id AS slot_id, p.event_id AS part_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, v ORDER BY ts, event_id) AS k FROM s) s JOIN (SELECT *, row_number() OVER (PARTITION BY user_id, v ORDER BY ts, event_id) AS k FROM p) p ON s.user_id = p.user_id AND s.v = p.v AND s.k = p.k),
s2 AS (SELECT * FROM s WHERE event_id NOT IN (SELECT slot_id FROM m1)), p2 AS (SELECT * FROM p WHERE event_id NOT IN (SELECT part_id FROM m1)),
m2 AS (SELECT s.event_id AS slot_id, p.event_id AS part_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM s2) s JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM p2) p ON s.user_id = p.user_id AND s.k = p.k)
SELECT slot_id, part_id, 1 AS pass FROM m1 UNION ALL SELECT slot_id, part_id, 2 FROM m2""")
def multi_pass_match(spark, d):
    e = table(spark, d, "events").withColumn("v", F.floor("value"))
    side = lambda kind, p: e.filter(F.col("event_type") == kind).select(F.col("event_id").alias(f"{p}_id"), "user_id", "v", F.col("ts").alias(f"{p}_pos"))
    return relational.matched(side("click", "slot"), side("purchase", "part"), [["user_id", "v"], ["user_id"]])


@query("""WITH RECURSIVE d AS (SELECT lang, doc_id, n_chars AS s, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
r AS (SELECT lang, doc_id, i, 1 AS chunk, 1 AS n, s AS t FROM d WHERE i = 1
UNION ALL SELECT d.lang, d.doc_id, d.i, CASE WHEN r.n >= 8 OR r.t + d.s > 20000 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.n >= 8 OR r.t + d.s > 20000 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 8 OR r.t + d.s > 20000 THEN d.s ELSE r.t + d.s END FROM r JOIN d ON d.lang = r.lang AND d.i = r.i + 1)
SELECT lang, doc_id, CAST(chunk AS INT) AS chunk FROM r""")
def chunk_packing(spark, d):
    return windows.packed(table(spark, d, "documents"), "lang", "doc_id", "n_chars", 8, 20000)


@query(f"""WITH a AS (SELECT l_orderkey, row_number() OVER w AS split, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {_LINES}, l_returnflag ROWS UNBOUNDED PRECEDING) AS upto, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {_LINES}, l_returnflag)),
b AS (SELECT *, round(abs(2 * upto - total), 6) AS apart, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(abs(2 * upto - total), 6), split) AS k FROM a)
SELECT l_orderkey, CAST(split AS INT) AS split, CAST(round(upto, 6) AS DOUBLE) AS left_height, CAST(apart AS DOUBLE) AS apart FROM b WHERE k = 1""")
def column_balance(spark, d):
    return windows.balanced(table(spark, d, "lineitem"), ["l_orderkey"], [*_LINES.split(", "), "l_returnflag"], "l_quantity").select("l_orderkey", "split", F.col("left_height").cast("double").alias("left_height"), F.col("apart").cast("double").alias("apart"))


@query("SELECT a.user_id AS user_id, round(a.value, 6) AS a, round(b.value, 6) AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND abs(a.value - b.value) <= 0.5")
def tolerance_pairs(spark, d):
    e = table(spark, d, "events").withColumnRenamed("value", "pos")
    return relational.near_pairs(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), "user_id", 0.5).select("user_id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("""WITH c AS (SELECT a.event_id AS l_id, b.event_id AS r_id, least(a.value + 10, b.value + 10) - greatest(a.value, b.value) AS o FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view')
SELECT l_id, r_id FROM c WHERE o / 10 >= 0.75""")
def interval_overlap(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "event_type", F.col("value").alias("y0"), (F.col("value") + 10).alias("y1"))
    return relational.overlapping(e.filter("event_type = 'click'"), e.filter("event_type = 'view'"), "user_id", 0.75, 20.0, height=10.0).select("l_id", "r_id")


@query("SELECT n_nationkey, r_name AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey")
def alias_lookup(spark, d):
    nations = table(spark, d, "nation").withColumn("key", F.upper(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))))
    regions = table(spark, d, "region").select(F.col("r_name").alias("id"), F.array(F.concat(F.lit("R"), F.col("r_regionkey").cast("string"))).alias("aliases"))
    return relational.by_alias(nations, "key", regions).select("n_nationkey", "canonical")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'd' || c_nationkey END AS segment FROM customer")
def settings_override(spark, d):
    c = table(spark, d, "customer")
    over = c.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("").alias("segment"))
    defaults = c.select("c_nationkey").distinct().select("c_nationkey", F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("segment"))
    return relational.effective(defaults, over, "c_nationkey").select("c_custkey", "segment")


@query("SELECT page_id FROM pages WHERE regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) LIKE '%.example' OR regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) = 'example' OR regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1) LIKE '%.com'")
def origin_filter(spark, d):
    p = table(spark, d, "pages").withColumnRenamed("url", "origin")
    ok = relational.origin_allowed(p, spark.createDataFrame([("*.example",), ("*.com",)], "pattern string"))
    return p.join(ok.distinct(), "origin", "left_semi").select("page_id")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def score_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).cast("double").alias("quantity"))


@query("SELECT user_id, round(var_pop(value), 6) AS variance, min(value) AS lo, max(value) AS hi FROM events GROUP BY user_id")
def profile_variance(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.var_pop("value"), 6).alias("variance"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("SELECT o_orderkey, CASE WHEN r >= 1.53 THEN 'Legal' WHEN r <= 1.35 THEN 'Letter' ELSE 'A4' END AS paper FROM (SELECT o_orderkey, (1 + o_orderkey % 89 / 89.0::DOUBLE) / 1.0 AS r FROM orders)")
def paper_size(spark, d):
    return table(spark, d, "orders").select("o_orderkey", calc.paper_size(1 + F.col("o_orderkey") % 89 / 89.0, F.lit(1.0)).alias("paper"))


@query("""WITH g AS (SELECT event_type, event_id FROM events)
SELECT event_id AS id, event_type || CASE WHEN k + x > 1 THEN ' (' || (k + x) || ')' ELSE '' END AS name FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END AS x FROM g)""")
def name_collisions(spark, d):
    g = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("name"))
    old = g.filter("name <> 'view'").select("name").distinct().withColumn("id", F.lit(-1).cast("long"))
    return relational.unique_names(old, g)


@query("""SELECT event_id AS id, event_type || CASE WHEN k + x > 1 THEN ' (' || (k + x) || ')' ELSE '' END AS name FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END AS x FROM events)""")
def event_names(spark, d):
    """All events, each with a name of its own."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("name"))
    old = e.filter("name <> 'view'").select("name").distinct().withColumn("id", F.lit(-1).cast("long"))
    return relational.unique_names(old, e)


@query("""SELECT event_id, CASE WHEN s = 429 AND b = 1 THEN 'RPD' WHEN s = 429 THEN 'RPM' WHEN s = 404 THEN 'UNKNOWN' WHEN s = 403 OR b = 2 THEN 'INVALID' WHEN s = 400 THEN 'FATAL_INPUT' WHEN s = 0 OR s >= 500 THEN 'SERVER' ELSE 'UNKNOWN' END AS class,
CASE WHEN s = 429 AND b = 1 THEN 3600000 WHEN s = 429 AND b = 3 THEN 34000 WHEN s = 429 OR s = 404 THEN 60000 WHEN s = 403 OR b = 2 THEN NULL WHEN s = 400 THEN 0 WHEN s = 0 OR s >= 500 THEN 60000 ELSE 60000 END AS reopen_after_ms
FROM (SELECT event_id, [0, 400, 403, 404, 429, 503, 302][event_id % 7 + 1] AS s, event_id % 4 AS b FROM events)""")
def error_classes(spark, d):
    bodies = F.array(F.lit('{"error":{"message":"oops"}}'), F.lit('{"error":{"message":"quota per day"}}'), F.lit("API key not valid"), F.lit('{"error":{"details":[{"@type":"x/RetryInfo","retryDelay":"34s"}]}}'))
    e = table(spark, d, "events").select("event_id", F.get(F.array(*(F.lit(x) for x in (0, 400, 403, 404, 429, 503, 302))), (F.col("event_id") % 7).cast("int")).alias("s"), F.get(bodies, (F.col("event_id") % 4).cast("int")).alias("b"))
    v = ledger.classify_error(F.col("s"), F.col("b"), F.lit(False), F.lit(1), F.lit(3_600_000))
    return e.select("event_id", v.alias("v")).select("event_id", "v.class", "v.reopen_after_ms")


@query("""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS n_lines, CAST(len(regexp_extract_all(text, '[A-Za-z]')) > 3 * len(regexp_extract_all(text, '[ঀ-৿]')) AS BOOLEAN) AS english FROM documents""")
def paper_language(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(F.split(t, "\n", -1), lambda x: F.trim(x) != "")).cast("long").alias("n_lines"), (text.paper_language(t) == "en").alias("english"))


@query("""SELECT conv_id, CAST(turn AS INT) AS turn, i AS pos, w AS word FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]{6,}') AS ws FROM conversations), unnest(range(0, len(ws))) AS u(i), LATERAL (SELECT ws[i + 1] AS w)""")
def word_rows(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", F.col("turn").cast("int").alias("turn"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 12 ELSE 0 END AS junk, CASE WHEN regexp_matches(text, '\\| ') THEN 8 ELSE 0 END AS tabular, CASE WHEN regexp_matches(text, '(?i)\\bthe\\b.*\\bthe\\b') THEN 6 ELSE 0 END AS prose FROM documents)
SELECT doc_id, CASE WHEN greatest(junk, tabular, prose) < 4 THEN 'GENERAL' WHEN junk >= greatest(tabular, prose) THEN 'JUNK' WHEN tabular >= prose THEN 'TABULAR' ELSE 'PROSE' END AS doc_type, CAST(greatest(junk, tabular, prose) AS INT) AS score FROM s""")
def score_classifier(spark, d):
    """The classifier's score columns, threshold and declared order of ties, with rules for the driver's texts."""
    rules = {"JUNK": [(12, ["[#$%&*]{3}"], [])], "TABULAR": [(8, [r"\| "], [])], "PROSE": [(6, [r"(?i)\bthe\b.*\bthe\b"], [])]}
    scores = classify.score_columns(F.col("text"), rules)
    top = classify.winner(scores)
    return table(spark, d, "documents").select("doc_id", top.alias("w")).select("doc_id", F.col("w.type").alias("doc_type"), F.col("w.score").alias("score"))


@query("""WITH q AS (SELECT doc_id, source, n_chars % 4 AS n, CAST(sum(n_chars % 4) OVER (ORDER BY doc_id) - n_chars % 4 AS BIGINT) AS b FROM documents)
SELECT b + i AS page, source AS file, CAST(i AS INT) AS page_in_file FROM q, unnest(range(1, n + 1)) AS u(i)""")
def page_sources(spark, d):
    q = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("file"), (F.col("n_chars") % 4).cast("int").alias("pages"))
    return documents.page_sources(q)


@query("SELECT a.event_id, a.n AS claimed, b.n AS measured FROM (SELECT event_id, event_id % 5 AS n FROM events) a JOIN (SELECT event_id, event_id % 7 AS n FROM events) b USING (event_id) WHERE a.n <> b.n")
def line_mismatches(spark, d):
    e = table(spark, d, "events")
    return documents.mismatches(e.select("event_id", (F.col("event_id") % 5).alias("n")), e.select("event_id", (F.col("event_id") % 7).alias("n")), ["event_id"])


@query("""WITH w AS (SELECT item_id, word FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS raw FROM benchmark), LATERAL (SELECT regexp_replace(regexp_replace(raw, '^[\\p{P}\\p{S}]+', ''), '[\\p{P}\\p{S}]+$', '') AS word) WHERE word <> ''),
a AS (SELECT item_id, word, count(*) AS n FROM w GROUP BY ALL), b AS (SELECT item_id, word, count(*) AS n FROM w WHERE length(word) > 3 GROUP BY ALL)
SELECT item_id, word, n - coalesce(m, 0) AS missing FROM (SELECT a.item_id, a.word, a.n, b.n AS m FROM a LEFT JOIN b ON a.item_id = b.item_id AND a.word = b.word) WHERE n > coalesce(m, 0)""")
def content_preservation(spark, d):
    b = table(spark, d, "benchmark")
    short = F.array_join(F.filter(text.words(F.col("text")), lambda w: F.length(w) > 3), " ")
    return documents.missing_words(b, b.withColumn("text", short), "item_id")


@query("SELECT conv_id, sha1(string_agg(name || ':' || sha1(text), chr(10) ORDER BY name)) AS fingerprint FROM (SELECT conv_id, role || turn AS name, any_value(text) AS text FROM conversations GROUP BY ALL) GROUP BY conv_id")
def package_fingerprint(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.concat("role", F.col("turn").cast("string")).alias("name"), F.col("text").alias("content"))
    return documents.fingerprint(c, "conv_id")


@query("SELECT CAST(r_regionkey AS INT) AS pos, CAST(r_regionkey AS INT) AS r_regionkey, r_name, true AS sound FROM region")
def export_import(spark, d):
    r = table(spark, d, "region")
    return documents.opened(documents.envelope(r, "regions", 1, ["r_regionkey", "r_name"], "r_regionkey"), "regions", 1, "struct<r_regionkey:int,r_name:string>", "r_name")


@query("SELECT doc_id, regexp_replace(regexp_replace(text, 'the', '⟨1⟩', 'g'), 'and', '⟨2⟩', 'g') AS text FROM documents")
def dictionary_replace(spark, d):
    words = spark.createDataFrame([("the", "⟨1⟩"), ("and", "⟨2⟩"), ("", "x"), ("of", " ")], "word string, replacement string")
    return documents.replaced(table(spark, d, "documents").select("doc_id", "text"), "text", words)


#: Words of the dictionary of ``corpus_dictionary``.
DICTIONARY_WORDS = 10_000


@query()
def corpus_dictionary(spark, d):
    """The most frequent words of all documents, each replaced by its rank wherever it occurs, the longest from the left, in one pass; a test holds it against an alternation of all words."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]{2,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = words.orderBy(F.desc("n"), "word").limit(DICTIONARY_WORDS)
    ranked = windows.listed(top, [F.desc("n"), "word"]).select("word", F.concat(F.lit("⟨"), F.col("place").cast("string"), F.lit("⟩")).alias("replacement"))
    return patterns.replaced_at_once(docs, "text", ranked)


@query("SELECT doc_id, translate(CAST(doc_id * 7919 AS VARCHAR), '0123456789', '০১২৩৪৫৬৭৮৯') || '।' AS text, CAST(doc_id * 7919 AS VARCHAR) || '|' AS legacy FROM documents")
def legacy_round_trip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(calc.to_bengali_digits(F.col("doc_id") * 7919), F.lit("।")).alias("t"))
    coded = docs.select("doc_id", transcode.to_legacy("t").alias("legacy"))
    return coded.select("doc_id", transcode.from_legacy("legacy").alias("text"), "legacy")


@query()
def legacy_texts(spark, d):
    """Whole texts in the legacy encoding, and those again in Unicode; no SQL has the encoding, tests hold it against pairs of words."""
    coded = table(spark, d, "documents").select("doc_id", transcode.to_legacy("text").alias("legacy"))
    return coded.select("doc_id", "legacy", transcode.from_legacy("legacy").alias("text"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13)) <> '')) AS BIGINT) AS lines FROM documents")
def markdown_lines(spark, d):
    """Blocks of the Markdown parser; their lines add up to those of the text."""
    b = table(spark, d, "documents").select("doc_id", papers.parse_blocks("text").alias("b"))
    n = lambda x: F.when(F.size(x["rows"]) > 0, F.size(x["rows"])).when(F.size(x["items"]) > 0, F.size(x["items"])).otherwise(F.size(F.split(x["text"], "\n")))
    return b.select("doc_id", F.aggregate("b", F.lit(0), lambda a, x: a + n(x)).cast("long").alias("lines"))


def _rule_scores() -> str:
    """The classifier's scoring rules as SQL over all documents: the highest score, and the first type that has it."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    holds = lambda need, never: " AND ".join([*(f"regexp_matches(t, {quoted(p)})" for p in need), *(f"NOT regexp_matches(t, {quoted(p)})" for p in never)])
    each = ", ".join(f"{' + '.join(f'CASE WHEN {holds(need, never)} THEN {points} ELSE 0 END' for points, need, never in rules)} AS {kind}" for kind, rules in classify.RULES.items())
    best = f"greatest({', '.join(classify.RULES)})"
    first = " ".join(f"WHEN {kind} = {best} THEN '{kind}'" for kind in classify.RULES)
    nukta = "replace(replace(replace(coalesce(text, ''), chr(2479) || chr(2492), chr(2527)), chr(2465) || chr(2492), chr(2524)), chr(2466) || chr(2492), chr(2525))"
    return f"WITH d AS (SELECT doc_id, trim({nukta}) AS t FROM documents), s AS (SELECT doc_id, {each} FROM d) SELECT doc_id, CASE {first} END AS doc_type, CAST({best} AS INT) AS score FROM s"


@query(_rule_scores())
def classify_plain(spark, d):
    """The scoring rules of the special types over all documents: the type of the highest score, ties to the one declared first."""
    t = F.trim(text.compose_nukta(F.coalesce("text", F.lit(""))))
    rows = table(spark, d, "documents").select("doc_id", t.alias("t")).withColumn("may", patterns.possible(F.col("t"), classify.patterns_of(classify.RULES)))
    scored = rows.select("doc_id", classify.ranked(classify.score_columns(F.col("t"), classify.RULES, F.col("may")))[0].alias("top"))
    return scored.select("doc_id", F.col("top.type").alias("doc_type"), F.col("top.score").alias("score"))


@query()
def classify_documents(spark, d):
    """All documents, all types; no SQL has these rules, tests hold it against a plain version."""
    return classify.classify(table(spark, d, "documents"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '(?s)\\$\\$.*?\\$\\$|\\$[^$]+?\\$')) AS BIGINT) AS spans, CAST(length(regexp_replace(text, '(?s)\\$\\$.*?\\$\\$|\\$[^$]+?\\$', '', 'g')) AS BIGINT) AS outside, true AS kept FROM (SELECT doc_id, '$a$ ' || replace(text, chr(92), '') || ' $b+1$' AS text FROM documents)")
def math_spans(spark, d):
    """Every document between two formulae: how many there are, what is left outside of them, and whether the shielded text with its formulae put back is the text again."""
    wrapped = F.concat(F.lit("$a$ "), F.replace("text", F.lit("\\"), F.lit("")), F.lit(" $b+1$"))
    s = table(spark, d, "documents").select("doc_id", wrapped.alias("text")).withColumn("s", maths.shielded("text"))
    outside = F.length(F.regexp_replace("s.text", "\ue000\\d+\ue001", ""))
    return s.select("doc_id", F.size("s.held").cast("long").alias("spans"), outside.cast("long").alias("outside"), (maths.unshielded("s") == F.col("text")).alias("kept"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 16 BETWEEN 1 AND 12 THEN CAST(o_orderkey % 16 AS INT) ELSE 0 END AS grade FROM orders")
def grade_parse(spark, d):
    n = calc.to_bengali_digits(F.col("o_orderkey") % 16)
    return table(spark, d, "orders").select("o_orderkey", text.grade(F.when(F.col("o_orderkey") % 3 == 0, "শ্রেণি নেই").otherwise(F.concat(F.lit("শ্রেণি: "), n, F.lit("ম")))).alias("grade"))


@query("SELECT o_orderkey, list_sort(list_distinct(list_concat(range(o_orderkey % 5 + 1, o_orderkey % 5 + 4), [least(o_orderkey % 9 + 1, 8)]))) AS pages FROM orders".replace("range(o_orderkey % 5 + 1, o_orderkey % 5 + 4)", "list_filter(range(o_orderkey % 5 + 1, o_orderkey % 5 + 4), lambda p: p <= 8)").replace("[least(o_orderkey % 9 + 1, 8)]", "list_filter([o_orderkey % 9 + 1], lambda p: p <= 8)"))
def page_ranges(spark, d):
    a, b = F.col("o_orderkey") % 5 + 1, F.col("o_orderkey") % 9 + 1
    spec = F.concat(calc.to_bengali_digits(a), F.lit("–"), (a + 2).cast("string"), F.lit(", "), b.cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.transform(text.page_range(spec, F.lit(8)), lambda p: p.cast("long")).alias("pages"))


@query("SELECT c_custkey, c_name AS text, translate(CAST(c_custkey % 10 AS VARCHAR), '0123456789', '০১২৩৪৫৬৭৮৯') AS mark FROM customer")
def trailing_marks(spark, d):
    line = F.concat("c_name", F.lit("  ["), calc.to_bengali_digits(F.col("c_custkey") % 10), F.lit("]"))
    return table(spark, d, "customer").select("c_custkey", text.split_mark(line).alias("m")).select("c_custkey", "m.text", "m.mark")


@query("SELECT c_custkey, c_mktsegment AS label, c_name AS value FROM customer")
def label_values(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.label_value(F.concat(F.lit("**"), F.col("c_mktsegment"), F.lit("**: "), F.col("c_name"))).alias("v")).select("c_custkey", "v.label", "v.value")


@query("SELECT c_custkey, c_mktsegment AS doc_type, CAST(c_nationkey AS VARCHAR) AS grade, c_name AS body FROM customer")
def frontmatter_split(spark, d):
    t = F.concat(F.lit("---\ndoc_type: "), F.col("c_mktsegment"), F.lit('\nGrade: "'), F.col("c_nationkey").cast("string"), F.lit('"\n---\n'), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", text.front(t).alias("f")).select("c_custkey", F.col("f.fields")["doc_type"].alias("doc_type"), F.col("f.fields")["grade"].alias("grade"), F.col("f.body").alias("body"))


@query("SELECT doc_id, CAST(n_chars % 7 + n_chars % 3 AS INT) AS cq, CAST(n_chars % 11 AS INT) AS mcq FROM documents")
def section_counts(spark, d):
    n = F.col("n_chars")
    said = F.concat(F.lit("[cq: "), calc.to_bengali_digits(n % 7), F.lit(", mcq="), (n % 11).cast("string"), F.lit("; cq x "), (n % 3).cast("string"), F.lit("]"))
    return table(spark, d, "documents").select("doc_id", text.sections(said).alias("s")).select("doc_id", F.col("s")["cq"].alias("cq"), F.col("s")["mcq"].alias("mcq"))


@query("""WITH g AS (SELECT CAST(floor(abs(o_totalprice) + 0.5) AS BIGINT) AS v, o_orderkey FROM orders)
SELECT o_orderkey, translate(CASE WHEN v < 1000 THEN CAST(v AS VARCHAR) WHEN v < 100000 THEN CAST(v // 1000 AS VARCHAR) || ',' || printf('%03d', v % 1000) WHEN v < 10000000 THEN CAST(v // 100000 AS VARCHAR) || ',' || printf('%02d', v // 1000 % 100) || ',' || printf('%03d', v % 1000) END, '0123456789', '০১২৩৪৫৬৭৮৯') AS money FROM g""")
def money_format(spark, d):
    return table(spark, d, "orders").select("o_orderkey", calc.money(F.abs("o_totalprice")).alias("money"))


@query("""WITH r AS (SELECT o_custkey AS doc, o_orderkey, o_orderpriority, CAST(floor(o_totalprice) AS BIGINT) AS v, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seen FROM orders)
SELECT doc, CAST(coalesce(sum(v) FILTER (seen = 0), 0) AS DOUBLE) AS earnings, CAST(coalesce(sum(v) FILTER (seen > 0), 0) AS DOUBLE) AS deductions, earnings - deductions AS net FROM r GROUP BY doc""")
def salary_totals(spark, d):
    """An order is a line of its customer's slip; from the first finished one on they are deductions."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), (2 * F.col("o_orderkey")).alias("pos"), "o_orderstatus", F.concat(F.lit("দফা: "), calc.to_bengali_digits(F.floor("o_totalprice")), F.lit(" টাকা")).alias("line"))
    heads = o.filter("o_orderstatus = 'F'").select("doc", (F.col("pos") - 1).alias("pos"), F.lit("কর্তন:").alias("line"))
    return relational.salary(o.select("doc", "pos", "line").unionByName(heads))


@query("SELECT count(*) FILTER (k % 3 = 0) AS ready, count(*) FILTER (k % 3 = 1) AS cooling, count(*) FILTER (k % 3 = 2) AS invalid, CAST(sum(n) AS BIGINT) AS requests FROM (SELECT user_id AS k, count(*) AS n FROM events GROUP BY user_id)")
def key_status_counts(spark, d):
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("requests"))
    return relational.key_status(s.withColumn("shown", F.when(F.col("k") % 3 == 0, "READY").when(F.col("k") % 3 == 1, "COOLING").otherwise("INVALID")))


@query("""WITH k AS (SELECT DISTINCT user_id AS key, user_id % 4 = 0 AS cooling FROM events WHERE user_id % 5 <> 0), p AS (SELECT *, row_number() OVER (PARTITION BY cooling ORDER BY key) - 1 AS place, count(*) FILTER (NOT cooling) OVER () AS active FROM k)
SELECT key, cooling, CASE WHEN cooling THEN place ELSE (place - 7 % active + active) % active END AS turn FROM p""")
def key_rotation(spark, d):
    keys = table(spark, d, "events").select(F.col("user_id").alias("key")).distinct().select("key", F.col("key").alias("idx"), (F.col("key") % 5 == 0).alias("invalid"), (F.col("key") % 4 == 0).alias("cooling"))
    return ledger.rotation(keys, 7, True).select("key", "cooling", F.col("turn").cast("long").alias("turn"))


@query("SELECT event_id FROM events WHERE event_type <> 'view' AND event_id NOT IN (SELECT event_id FROM events WHERE value > 80)")
def read_once_store(spark, d):
    e = table(spark, d, "events")
    return relational.consumed(e.filter("event_type <> 'view'"), e.filter("value > 80"), "event_id").select("event_id")


@query("""WITH b AS (SELECT event_id AS id, event_type AS text, user_id AS style FROM events WHERE event_id % 3 <> 0), a AS (SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'x' ELSE event_type END AS text, CASE WHEN event_id % 4 = 0 THEN 0 ELSE user_id END AS style FROM events WHERE event_id % 5 <> 0),
j AS (SELECT b.id AS was, a.id AS now, b.text = a.text AS t, b.style = a.style AS s FROM b FULL JOIN a ON a.id = b.id)
SELECT round(count(*) FILTER (was IS NOT NULL AND now IS NOT NULL) / count(was), 9) AS kept, round(count(*) FILTER (t) / count(*) FILTER (was IS NOT NULL AND now IS NOT NULL), 9) AS same_text, round(count(*) FILTER (s) / count(*) FILTER (was IS NOT NULL AND now IS NOT NULL), 9) AS same_style, count(*) FILTER (was IS NULL) AS added FROM j""")
def edit_scores(spark, d):
    e = table(spark, d, "events")
    before = e.filter("event_id % 3 <> 0").select(F.col("event_id").alias("id"), F.col("event_type").alias("text"), F.col("user_id").alias("style"))
    after = e.filter("event_id % 5 <> 0").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 10 == 0, "x").otherwise(F.col("event_type")).alias("text"), F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.col("user_id")).alias("style"))
    s = relational.edit_score(before, after)
    return s.select(*(F.round(c, 9).alias(c) for c in ("kept", "same_text", "same_style")), "added")


@query("""SELECT event_id, CASE WHEN s IN (401, 403) THEN 'unauthorized' WHEN s = 429 AND b = 1 THEN 'daily_cap' WHEN s = 429 THEN 'all_cooling' WHEN b = 2 THEN 'location' WHEN b = 3 THEN 'fatal_input' WHEN s = 0 OR s >= 500 THEN 'server_error' ELSE 'unknown' END AS kind,
CASE WHEN s IN (401, 403) THEN 0 WHEN s = 429 AND b = 1 THEN 50 WHEN s = 429 THEN 0 WHEN b = 2 THEN 90 WHEN b = 3 THEN 0 WHEN (s = 0 OR s >= 500) AND b = 1 THEN 50 ELSE 60 END AS wait_sec
FROM (SELECT event_id, [0, 401, 403, 404, 429, 503][event_id % 6 + 1] AS s, event_id % 4 AS b FROM events)""")
def proxy_failures(spark, d):
    bodies = F.array(F.lit("{}"), F.lit('{"limit":"ip_daily","retryInSec":50}'), F.lit('{"attempts":[{"class":"SERVER"},{"class":"LOCATION"}]}'), F.lit('{"attempts":[{"class":"FATAL_INPUT"}]}'))
    e = table(spark, d, "events").select("event_id", F.get(F.array(*(F.lit(x) for x in (0, 401, 403, 404, 429, 503))), (F.col("event_id") % 6).cast("int")).alias("s"), F.get(bodies, (F.col("event_id") % 4).cast("int")).alias("b"))
    return e.select("event_id", relational.failure(F.col("s"), F.col("b")).alias("f")).select("event_id", "f.kind", F.col("f.wait_sec").cast("int").alias("wait_sec"))


@query("SELECT l_orderkey AS doc, CASE WHEN l >= 3 AND r >= 3 AND l + r >= 6 AND l + r > 2 * w THEN 2 ELSE 1 END AS columns FROM (SELECT l_orderkey, count(*) FILTER (l_quantity < 20) AS l, count(*) FILTER (l_quantity BETWEEN 20 AND 40) AS r, count(*) FILTER (l_quantity > 40) AS w FROM lineitem GROUP BY l_orderkey)")
def page_columns(spark, d):
    q = F.col("l_quantity")
    box = F.when(q < 20, F.array(*(F.lit(x) for x in (0.0, 50.0, 10.0, 480.0)))).when(q <= 40, F.array(*(F.lit(x) for x in (0.0, 520.0, 10.0, 950.0)))).otherwise(F.array(*(F.lit(x) for x in (0.0, 50.0, 10.0, 950.0))))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), F.lit("paragraph").alias("role"), box.alias("box"))
    return documents.columns_of(li).select("doc", "columns")


@query("SELECT o_orderkey, CASE WHEN m <= 240 / 4.0 - 6 THEN 4 WHEN m <= 240 / 2.0 - 6 THEN 2 ELSE 1 END AS columns FROM (SELECT o_orderkey, greatest(o_orderkey % 97, o_orderkey % 131) AS m FROM orders)")
def option_columns(spark, d):
    w = F.array((F.col("o_orderkey") % 97).cast("double"), (F.col("o_orderkey") % 131).cast("double"))
    return table(spark, d, "orders").select("o_orderkey", text.options_grid(w, F.lit(240.0)).alias("columns"))


@query("""SELECT event_id, CASE WHEN p > 0 THEN floor(p / 1.15 * 2 + 0.5) / 2 ELSE floor(i / 0.98 * 2 + 0.5) / 2 END AS raw, CAST(least(48, greatest(6, raw)) AS DOUBLE) AS points FROM (SELECT event_id, CAST(value AS DOUBLE) AS p, CAST(event_id % 60 AS DOUBLE) AS i FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value ELSE 0 END AS value FROM events))""".replace("SELECT event_id, CASE WHEN p", "SELECT event_id, CAST(least(48, greatest(6, raw)) AS DOUBLE) AS points FROM (SELECT event_id, CASE WHEN p").replace(" AS raw, CAST(least(48, greatest(6, raw)) AS DOUBLE) AS points FROM (SELECT event_id, CAST(value", " AS raw FROM (SELECT event_id, CAST(value").replace("1.15 ", "1.15::DOUBLE ").replace("0.98 ", "0.98::DOUBLE ") + ")")
def font_estimate(spark, d):
    e = table(spark, d, "events").withColumn("p", F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(0.0))
    return e.select("event_id", calc.font_points((F.col("event_id") % 60).cast("double"), F.col("p")).alias("points"))


@query("SELECT conv_id, turn, role || ': ' || text AS line FROM conversations")
def nested_rewrite(spark, d):
    """Turns gathered into an array of structs, one field rewritten in place, and flattened again."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("xs"))
    out = c.select("conv_id", F.explode(F.transform("xs", lambda x: x.withField("text", F.concat(x["role"], F.lit(": "), x["text"])))).alias("x"))
    return out.select("conv_id", "x.turn", F.col("x.text").alias("line"))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _drained(stream: DataFrame, mode: str, keys: list[str], order: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """The last result of each key over the files that are there now; micro-batches are written to the shared folder, nothing is held by the driver."""
    path = f"{storage.new_path(stream.sparkSession, 'stream')}/t"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("micro batch", F.lit(number)).write.mode("append").parquet(path)

    run = stream.writeStream.outputMode(mode).foreachBatch(keep).trigger(availableNow=True).option("checkpointLocation", storage.new_path(stream.sparkSession, "stream-state")).start()
    run.awaitTermination()
    written = stream.sparkSession.read.parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("micro batch", *order)).alias("last")).select(*keys, "last.*")


@query("SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS n, greatest(count(*) - 3, 0) AS blocked FROM events GROUP BY ALL")
def daily_cap_stream(spark, d):
    """The daily cap as a stream: tumbling windows under a watermark, drained over the files at hand."""
    e = _event_stream(spark, d).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return _drained(limits.limited(e, "user_id", "ts", "1 day", 3), "update", ["user_id", "window_start"]).select("user_id", "window_start", "n", "blocked")


@query("""WITH e AS (SELECT user_id, event_type <> 'error' AS ok, event_type, event_id, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS day, ts FROM events),
l AS (SELECT user_id, arg_max(day, (ts, event_id)) AS day, arg_max(event_id, (ts, event_id)) AS last_id FROM e GROUP BY user_id),
t AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
SELECT CAST(l.user_id AS VARCHAR) AS key, (SELECT count(*) FROM e WHERE e.user_id = l.user_id AND e.day = l.day) AS requests, (SELECT count(*) FROM e WHERE e.user_id = l.user_id AND e.day = l.day AND ok) AS success,
(SELECT count(*) FROM e WHERE e.user_id = l.user_id AND e.day = l.day AND NOT ok) AS fail, (SELECT count(*) FROM t WHERE t.user_id = l.user_id AND NOT ok AND run = (SELECT max(run) FROM t t2 WHERE t2.user_id = l.user_id)) AS fail_streak FROM l""")
def ledger_stream_fold(spark, d):
    """Keyed state over a stream: counts of the last Pacific day and the streak of server failures at the end."""
    ts = F.col("ts").cast("timestamp")
    e = _event_stream(spark, d).select(F.col("user_id").cast("string").alias("key"), calc.pacific_day(ts).cast("string").alias("day"), F.unix_micros(ts).alias("at_ms"), F.col("event_id").cast("int").alias("seq"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") == "error", "SERVER").alias("cls"), (F.col("value") * 10).cast("long").alias("latency_ms"), F.lit(30000).cast("long").alias("reopen_after_ms"))
    return _drained(limits.ledger_stream(e), "update", ["key"]).select("key", "requests", "success", "fail", "fail_streak")


def _requests(events: DataFrame) -> DataFrame:
    """Events as requests of a key to a model: an error fails and closes the model for as many minutes as its value says."""
    ts = F.col("ts").cast("timestamp")
    bad = F.col("event_type") == "error"
    return events.select(F.col("user_id").cast("string").alias("key"), ts.alias("ts"), F.col("event_id").alias("seq"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"), (~bad).alias("ok"), F.when(bad, "SERVER").alias("cls"), F.when(bad, F.floor(F.col("value") * 60_000)).alias("reopen_after_ms"))


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type <> 'error' AS ok, value, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS day FROM events),
n AS (SELECT max(ts) - INTERVAL 10 MINUTE AS now FROM events),
l AS (SELECT user_id, max(day) AS day, arg_max(ok, (ts, event_id)) AS last_ok, arg_max(ts, (ts, event_id)) AS last_ts, arg_max(value, (ts, event_id)) AS last_value FROM e GROUP BY user_id),
t AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e),
s AS (SELECT user_id, count(*) FILTER (NOT ok) AS streak FROM t JOIN (SELECT user_id, max(run) AS run FROM t GROUP BY user_id) USING (user_id, run) GROUP BY user_id),
c AS (SELECT l.user_id, l.day, count(*) AS n, count(*) FILTER (ok) AS good FROM l JOIN e ON e.user_id = l.user_id AND e.day = l.day GROUP BY ALL),
r AS (SELECT l.*, n, good, streak, ((CAST(l.day + 1 AS TIMESTAMP) AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'UTC') <= now AS turned, epoch_ms(last_ts) + floor(last_value * 60000) > epoch_ms(now) AND NOT last_ok AS cooling FROM l JOIN c USING (user_id) JOIN s USING (user_id), n)
SELECT CAST(user_id AS VARCHAR) AS key, CAST(CASE WHEN turned THEN 0 ELSE n END AS BIGINT) AS requests, CAST(CASE WHEN turned THEN 0 ELSE good END AS BIGINT) AS success, CAST(CASE WHEN turned THEN 0 ELSE n - good END AS BIGINT) AS fail, CAST(streak AS BIGINT) AS fail_streak, turned AS day_turned, cooling FROM r""")
def ledger_timers(spark, d):
    """Keyed state with timers over the events as a stream: a key that has fallen silent has its counters set back at Pacific midnight and its cooldowns ended."""
    with timers.rocks(spark):
        updates = timers.ledger(_requests(_event_stream(spark, d)))
        last = _drained(updates, "update", ["key"], ["at_ms", "by_timer"])
    turned = F.col("by_timer") & (F.col("requests") == 0)
    return last.select("key", "requests", "success", "fail", "fail_streak", turned.alias("day_turned"), (F.size("cooling") > 0).alias("cooling"))


_MEMO_KEY = "concat_ws('|', 'v1', 'template', CASE WHEN lang = 'en' THEN NULL ELSE lang END, sha256(text))"


@query(f"""WITH d AS (SELECT doc_id, {_MEMO_KEY} AS cache_key, doc_id % 3 AS batch, length(text) AS n_chars, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS n_words FROM documents)
SELECT doc_id, cache_key, CAST(min(batch) OVER w AS BIGINT) AS made_in, batch > min(batch) OVER w AS hit, CAST(n_chars AS BIGINT) AS kept_chars, CAST(n_words AS BIGINT) AS kept_words FROM d WINDOW w AS (PARTITION BY cache_key)""")
def memoised_runs(spark, d):
    """All documents in three batches, the second of which comes twice; a text is measured once, in the first batch that has it, and found by key ever after."""
    docs = table(spark, d, "documents")
    docs = docs.select("doc_id", "text", relational.cache_key(F.lit("v1"), F.lit("template"), F.when(F.col("lang") != "en", F.col("lang")), relational.content_hash(F.array("text"))).alias("cache_key"), F.pmod("doc_id", F.lit(3)).alias("batch"))
    memo = kept.Kept(spark, storage.new_path(spark, "memo"), "cache_key string, made_in long, kept_chars long, kept_words long", ["cache_key"], ["made_in"])

    def measured(number: int):
        words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0B\f\r]+"), 0)).cast("long")
        return lambda rows: rows.select("cache_key", F.lit(number).cast("long").alias("made_in"), F.length("text").cast("long").alias("kept_chars"), words.alias("kept_words"))

    runs = {n: kept.memoised(memo, n, docs.filter(F.col("batch") == n), measured(n), ["text"]) for n in (0, 1, 1, 2)}
    return reduce(DataFrame.unionByName, runs.values()).select("doc_id", "cache_key", "made_in", "hit", "kept_chars", "kept_words")


@query(f"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1)
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM l WHERE floor(epoch({LAST})) - floor(epoch(ts)) <= 604800) WHERE r <= 3""")
def stored_history(spark, d):
    """Events committed to a keyed table in three batches, one of them twice, with compactions between: the latest of each user and type, of these the newest three of a week."""
    e = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    history = kept.Kept(spark, storage.new_path(spark, "history"), "user_id long, event_type string, ts timestamp, event_id long, value double", ["user_id", "event_type"], ["ts", "event_id"], most=(["user_id"], "ts", 604800, 3, "event_id"))
    for n in (0, 1, 1, 2):
        history.commit(n, e.filter(F.pmod("event_id", F.lit(3)) == n))
        history.compact()
    return history.read().select("user_id", "event_type", "event_id", "value")


_COPIES = """WITH l AS (SELECT doc_id, source, pos, trim(line, ' ') AS line FROM (SELECT doc_id, source, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)) WHERE trim(line, ' ') <> ''),
f AS (SELECT source, line, min(doc_id) AS base FROM l GROUP BY ALL),
v AS (SELECT doc_id, base, count(*) AS shared FROM l JOIN f USING (source, line) WHERE base < doc_id GROUP BY ALL),
b AS (SELECT doc_id, base, shared FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, base) AS k FROM v) WHERE k = 1)"""


@query(_COPIES + " SELECT doc_id, base, shared FROM b")
def copy_bases(spark, d):
    """Each document's earlier copy within its source: the document that first had most of its lines."""
    return order.bases(order.lines(table(spark, d, "documents"), "doc_id", "source", "text"), "doc_id", "source")


@query(_COPIES + """, o AS (SELECT doc_id, line, min(pos) AS pos FROM l GROUP BY ALL HAVING count(*) = 1),
m AS (SELECT b.doc_id, b.base, CAST(abs(x.pos - y.pos) AS DOUBLE) AS moved FROM b JOIN o x ON x.doc_id = b.doc_id JOIN o y ON y.doc_id = b.base AND y.line = x.line)
SELECT doc_id, base, count(*) AS matched, round(avg(moved), 9) AS mean_moved, list_sort(list(moved))[CAST(floor(count(*) / 2) AS INT) + 1] AS median_moved FROM m GROUP BY ALL""")
def moved_lines(spark, d):
    """How far lines lie from their places in that copy."""
    lined = storage.table(order.lines(table(spark, d, "documents"), "doc_id", "source", "text"), "lines")
    return order.moved_lines(lined, order.bases(lined, "doc_id", "source"), "doc_id").withColumn("mean_moved", F.round("mean_moved", 9))


@query()
def order_scores(spark, d):
    """The share of the copied document's words that a document has in the same order; no SQL finds longest common sequences of whole texts, a test does by dynamic programming."""
    docs = table(spark, d, "documents")
    based = order.bases(order.lines(docs, "doc_id", "source", "text"), "doc_id", "source")
    pairs = based.join(docs.select("doc_id", F.col("text").alias("out")), "doc_id").join(docs.select(F.col("doc_id").alias("base"), F.col("text").alias("truth")), "base")
    return order.order_scores(pairs, "truth", "out").select("doc_id", "base", "total", "ordered", "order_score")


@query(r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<style[^>]*>(.*?)</style>', 1)) AS sheet FROM pages),
r AS (SELECT page_id, unnest(regexp_extract_all(sheet, '[^{]+\{[^}]+\}')) AS rule FROM s),
b AS (SELECT page_id, unnest(string_split(split_part(rule, '{', 1), ',')) AS selector, unnest(string_split(rtrim(split_part(rule, '{', 2), '}'), ';')) AS d FROM r)
SELECT page_id, trim(selector) AS selector, lower(trim(split_part(d, ':', 1))) AS name, trim(d[instr(d, ':') + 1:]) AS value FROM b WHERE instr(d, ':') > 1""")
def sheet_declarations(spark, d):
    """Every declaration of the style sheets in pages, by selector."""
    all_nodes = markup.nodes(table(spark, d, "pages"), ["page_id"], "html")
    said = markup.sheet_rules(all_nodes, ["page_id"]).select("page_id", "selector", F.explode(markup.declarations(F.col("body"))).alias("said"))
    return said.select("page_id", "selector", "said.name", "said.value")


_TEXTS = r"""WITH t AS (SELECT page_id, unnest(range(len(ts))) AS i, unnest(ts) AS tok FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script.*?</script>|<style.*?</style>|<title.*?</title>|<!--.*?-->|<[^>]*>|[^<]+') AS ts FROM pages)),
c AS (SELECT *, count(*) FILTER (tok = '<b>') OVER w > 0 AS bold, count(*) FILTER (tok = '<h1>') OVER w > count(*) FILTER (tok = '</h1>') OVER w AS title FROM t WINDOW w AS (PARTITION BY page_id ORDER BY i))"""


@query(_TEXTS + r""" SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS place, regexp_replace(replace(replace(replace(tok, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&amp;?', '&', 'g') AS text,
NULL::VARCHAR AS font_family, CASE WHEN title THEN '18pt' ELSE '12pt' END AS font_size, bold OR title AS is_bold, false AS is_italic, false AS is_underline, NULL::VARCHAR AS color, NULL::VARCHAR AS bg_color, 'left' AS text_align
FROM c WHERE NOT starts_with(tok, '<') AND trim(tok, chr(32) || chr(9) || chr(10) || chr(13)) <> ''""")
def text_styles(spark, d):
    """The style of every text of all pages. The SQL knows what these pages hold: titles, and bold elements that nothing ends, so that all texts behind one are bold."""
    return markup.text_styles(table(spark, d, "pages"), ["page_id"], "html").drop("tag")
