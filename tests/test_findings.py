"""Rows on which queries once failed or differed from their SQL: ties, values without a distance, plans that grew with their rounds."""

import duckdb
import pytest
from docloom.operators import relational, windows
from docloom.plans import catalogue
from pyspark.sql import functions as F


def from_sql(name, events):
    db = duckdb.connect()
    db.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    db.executemany("INSERT INTO events VALUES (?, ?, ?, ?)", events)
    return sorted(db.execute(catalogue.SQL[name]).fetchall(), key=str)


def test_fits_read_rows_that_a_round_has_written(spark):
    rows = [(k, float(i), 2.0 * i + (i * k) % 7 + (50 if i % 11 == 3 else 0)) for k in (1, 2, 3) for i in range(40)] + [(4, 5.0, float(i)) for i in range(8)]
    fit = windows.trimmed_fit(spark.createDataFrame(rows, "k int, x double, y double"), ["k"], "x", "y", 4)
    plan = fit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") < 10
    got = {r.k: r for r in fit.collect()}
    assert sorted(got) == [1, 2, 3, 4]
    # all of one x: no slope, no residuals, and so no row goes
    assert got[4].slope is None and got[4].n == 8


def test_overlaps_are_shares_of_the_stated_height(spark, tmp_path):
    values = [round(0.01 * i, 2) for i in range(0, 3000, 7)]
    events = [(i, 1, "click", v) for i, v in enumerate(values)] + [(10_000 + i, 1, "view", round(v + 2.5, 2)) for i, v in enumerate(values)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((tuple(r) for r in catalogue.QUERIES["interval_overlap"](spark, str(tmp_path)).collect()), key=str)
    assert got == from_sql("interval_overlap", events)


def test_overlaps_of_boxes_of_any_height(spark):
    box = lambda rows: spark.createDataFrame(rows, "k int, id int, y0 double, y1 double")
    assert [tuple(r) for r in relational.overlapping(box([(1, 1, 0.0, 40.0)]), box([(1, 2, 38.0, 42.0), (1, 3, 36.0, 40.0)]), "k", 0.75).collect()] == [(1, 1, 3)]


@pytest.mark.parametrize("spread", [False, True])
def test_islands_with_ties_and_without_distances(spark, spread):
    rows = [(1, float(v)) for v in range(0, 600, 3) for _ in range(8)] + [(1, None), (1, None), (1, float("inf")), (1, float("inf")), (2, None), (2, 1.0)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(8)
    found = windows.islands(df, ["k"], "v", 2.0, spread=spread)
    got = sorted(((r.k, r.run, r.lo, r.hi, r.n) for r in found.collect()))
    want = [(1, i + 1, 3.0 * i, 3.0 * i, 8) for i in range(200)] + [(1, 201, float("inf"), float("inf"), 1), (1, 202, float("inf"), float("inf"), 1), (1, 203, None, None, 1), (1, 204, None, None, 1), (2, 1, 1.0, 1.0, 1), (2, 2, None, None, 1)]
    assert got == want
    assert sorted((r.k, r.top, r.bottom) for r in windows.bands(found, ["k"]).filter("k = 2").collect()) == []


def test_islands_have_the_rows_of_their_sql(spark, tmp_path):
    events = [(i, i % 3, "view", v) for i, v in enumerate([None, 1.0, 2.5, None, 9.0, 11.5, 40.25, 41.0, None, 3.0, 7.75, 70.0])]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    for name in ("line_islands", "rule_bands"):
        assert sorted((tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()), key=str) == from_sql(name, events)


def test_members_of_many_buckets_meet_once(spark):
    from docloom.llm import neardup

    # 30 nodes of one component and 10 alone, nearly all of them in each of 32 buckets
    many = [(band, node, 5, 0 if node < 30 else node) for band in range(32) for node in range(40) if (band + node) % 9]
    # two buckets of one component that have nothing else in common: met as one, they would compare more
    few = [(100 + band, 1000 + 100 * band + i, 5, 1000 if i < 20 else 5000 + band) for band in range(2) for i in range(21)]
    rest = spark.createDataFrame(many + few, "band long, node long, size long, component long")
    got = neardup._met_once(rest).collect()
    whole = [r for r in got if r.whole]
    assert sorted(r.node for r in whole) == list(range(40)) and {(r.band, r.m, r.total) for r in whole} == {(0, 40, 200)}
    assert sorted((r.band, r.node) for r in got if not r.whole) == sorted((b, n) for b, n, _, _ in few) and {r.m for r in got if not r.whole} == {21}


@pytest.mark.parametrize("neighbours", [0, 12, 64])
def test_turns_meet_their_neighbours_whole(spark, monkeypatch, neighbours):
    from test_similarity import brute, texts

    monkeypatch.setattr(relational, "NEIGHBOURS", neighbours)
    asked = []
    monkeypatch.setattr(relational, "_prefixed", lambda *a, by=relational._prefixed: asked.append(1) or by(*a))
    left, right = ([(i, f"{k}{i % 5}" if k else k, p, t) for i, k, p, t in texts(seed, 60) if neighbours != 64 or p is not None] for seed in (1, 2))
    df = lambda rows: spark.createDataFrame(rows, "id long, k string, page int, text string")
    got = {(r.a, r.b): r.similarity for r in relational.match_candidates(df(left), df(right), 0.6, 0.25, ("k",)).collect()}
    want = brute(left, right, 0.6, 0.25)
    assert want and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    assert bool(asked) == (neighbours != 64)


def test_words_are_transcribed_once():
    from docloom.parse import transcode

    transcode._kept_decoded.cache_clear()
    assert transcode.decode("Avwg fvj AvwQ\n" * 50) == transcode.decoded("Avwg fvj AvwQ\n") * 50
    assert transcode._kept_decoded.cache_info().misses <= 4


def test_words_between_blanks_are_replaced_once(spark, monkeypatch):
    from docloom.operators import patterns

    words = spark.createDataFrame([("ab", "1"), ("b", "2"), ("bca", "3")], "word string, replacement string")
    texts = spark.createDataFrame([(1, "abca bca\n ab"), (2, None), (3, "x" * 40 + "ab")], "id int, t string")
    assert sorted(map(tuple, patterns.replaced_at_once(texts, "t", words).collect())) == [(1, "1ca 3\n 1", 3), (2, None, 0), (3, "x" * 40 + "1", 1)]
    blank = words.unionByName(spark.createDataFrame([("a b", "4")], words.schema))
    assert patterns.replaced_at_once(texts, "t", blank).filter("id = 1").first().t == "1c4ca\n 1"
    # the dictionary's own query runs once, however often its size and entries are asked for
    made = []
    monkeypatch.setattr(patterns.storage, "table", lambda d, label, by=patterns.storage.table: made.append(label) or by(d, label))
    patterns.replaced_at_once(texts, "t", words)
    assert made == ["entries"]


def test_batches_become_objects_slice_by_slice(spark, monkeypatch):
    from docloom.parse import udfs

    monkeypatch.setattr(udfs, "SLICE_BYTES", 100)
    assert list(udfs.slices(1000, 20)) == [(at, 2) for at in range(0, 20, 2)] and list(udfs.slices(10**6, 2)) == [(0, 1), (1, 1)] and list(udfs.slices(0, 0)) == []
    rows = [(i, None if i % 7 == 3 else "word " * i) for i in range(50)]
    held = udfs.over_text(lambda t: t.split(), "array<string>")
    got = {r.i: r.w for r in spark.createDataFrame(rows, "i int, t string").coalesce(1).select("i", held("t").alias("w")).collect()}
    assert got == {i: None if t is None else t.split() for i, t in rows}


def test_results_are_given_on_before_the_next_rows_are_read(monkeypatch):
    import pyarrow as pa
    from docloom.parse import udfs

    monkeypatch.setattr(udfs, "SLICE_BYTES", 100)
    asked = []
    texts = ["", None, *["a" * 10] * 40, *["b" * 100] * 3, ""]
    found = udfs.in_slices(lambda t: asked.append(t) or len(t), iter([(pa.array(texts),), (pa.array([], pa.string()),), (pa.array(["c"]),)]), pa.int64())
    first = next(found)
    assert len(asked) <= len(first) < 20
    rest = list(found)
    assert [n for x in (first, *rest) for n in x.to_pylist()] == [*(None if t is None else len(t) for t in texts), 1]
    # however rows differ in size, an array ends where its texts come to a slice
    assert all(sum(n or 0 for n in x.to_pylist()[:-1]) < 100 for x in (first, *rest))
    pairs = udfs.in_slices(lambda a, b: a + b, iter([(pa.array(["a", None, "c"]), pa.array(["x", "y", None]))]), pa.string())
    assert [t for x in pairs for t in x.to_pylist()] == ["ax", None, None]


def test_a_task_does_not_hold_the_results_of_a_batch(spark):
    from docloom.parse import udfs

    def held(text):
        with open("/proc/self/statm") as f:
            return f"{int(f.read().split()[1]) * 4096 // 1_000_000} {text * 10}"

    rows = spark.range(2000).coalesce(1).select("id", udfs.over_text(held, "string")(F.repeat(F.lit("x"), 10_000)).alias("t")).select("id", F.split("t", " ")[0].cast("int").alias("mb"))
    mb = [r.mb for r in sorted(rows.collect())]
    # 2000 results of 100 kB, all in one batch: once a few slices have gone by, nothing is added
    assert mb[-1] - mb[500] < 50


def test_results_of_functions_over_functions(spark):
    from docloom.parse import udfs

    upper, size, both = udfs.over_text(str.upper, "string"), udfs.over_text(len, "int"), udfs.over_text(lambda a, b: a + b, "string")
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "i int, t string").repartition(3)
    got = df.select("i", upper("t").alias("u"), size(upper("t")).alias("n"), both("t", upper("t")).alias("b"), F.when(size("t") > 1, upper("t")).alias("c"))
    assert sorted(map(tuple, got.collect())) == [(1, "AB", 2, "abAB", "AB"), (2, None, None, None, None), (3, "", 0, "", None)]
    assert df.limit(0).select(upper("t")).collect() == [] and df.filter(size("t") == 2).count() == 1
