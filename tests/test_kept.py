"""A keyed table with commits: each batch once, latest wins, retention, compaction and streams that start again."""

import datetime as dt
import random

import pytest
from docloom import storage
from docloom.streaming import kept
from pyspark.sql import functions as F

SCHEMA = "k string, at long, id long, v string"


def new(spark, tmp_path, **more):
    return kept.Kept(spark, f"file://{tmp_path}/kept", SCHEMA, ["k"], ["at", "id"], buckets=4, **more)


def plain(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        out[r[0]] = r
    return sorted(out.values(), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, n):
    r = random.Random(seed)
    return [(r.choice([None, "a", "b", *(f"k{i}" for i in range(20))]), r.choice([None, r.randrange(50)]), i + 1000 * seed, r.choice([None, "x", "y"])) for i in range(n)]


def test_batches_count_once_and_the_latest_wins(spark, tmp_path):
    table, rows = new(spark, tmp_path), []
    assert got(table.read()) == []
    for n in range(5):
        part = made(n, 60) if n != 3 else []
        assert table.commit(n, spark.createDataFrame(part, SCHEMA))
        assert not table.commit(n, spark.createDataFrame(made(99, 10), SCHEMA))
        rows += part
        assert got(table.read()) == plain(rows)
        if n in (1, 2, 4):
            table.compact()
            table.compact()
            assert got(table.read()) == plain(rows)
    assert table.committed() == [0, 1, 2, 3, 4]
    assert got(table.read(before=4)) == plain([r for r in rows if r[2] < 4000])
    with pytest.raises(ValueError, match="later snapshot"):
        table.read(before=1)


def test_a_batch_that_fell_over_is_written_anew(spark, tmp_path):
    table = new(spark, tmp_path)
    spark.createDataFrame([("lost", 1, 1, "x")], SCHEMA).withColumn("kept_bucket", F.lit(2)).write.partitionBy("kept_bucket").parquet(table._at("delta", 0))
    assert got(table.read()) == []
    assert table.commit(0, spark.createDataFrame([("a", 1, 1, "x"), ("a", 1, 1, "x")], SCHEMA))
    assert got(table.read()) == [("a", 1, 1, "x")]


def test_only_buckets_of_wanted_keys_are_read(spark, tmp_path):
    table = new(spark, tmp_path)
    table.commit(0, spark.createDataFrame(made(1, 200), SCHEMA))
    some = spark.createDataFrame([("a",), (None,), ("absent",), ("a",)], "k string")
    found = table.read(wanted=some)
    assert got(found) == [r for r in plain(made(1, 200)) if r[0] in ("a", None)]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [kept_bucket" in plan or "kept_bucket" in plan.split("PartitionFilters")[1][:60]


def test_names_of_folders_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="kept_bucket"):
        kept.Kept(spark, str(tmp_path), "k string, kept_bucket int", ["k"], ["k"])


@pytest.mark.parametrize("compact", [False, True])
def test_retention(spark, tmp_path, compact):
    day = dt.datetime(2024, 5, 1)
    rows = [(f"k{i}", f"o{i % 3}", day + dt.timedelta(hours=i), i) for i in range(60)]
    table = kept.Kept(spark, f"file://{tmp_path}/kept", "k string, o string, at timestamp, id long", ["k"], ["at", "id"], most=(["o"], "at", 36 * 3600, 5, "id"))
    for n in range(3):
        table.commit(n, spark.createDataFrame(rows[20 * n : 20 * n + 20], "k string, o string, at timestamp, id long"))
        if compact:
            table.compact()
    assert sorted(r.id for r in table.read().collect()) == list(range(45, 60))


def test_memoised_batches_compute_each_key_once(spark, tmp_path):
    table = kept.Kept(spark, f"file://{tmp_path}/kept", "k string, n long, by long", ["k"], ["by"], buckets=4)
    asked = []

    def compute(number):
        def run(rows):
            rows = storage.table(rows, "asked")
            asked.extend((number, r.k) for r in rows.collect())
            return rows.select("k", F.length("text").cast("long").alias("n"), F.lit(number).cast("long").alias("by"))

        return run

    batches = [["a", "bb", "a", None], ["bb", "ccc"], [], ["a", "dddd", None]]
    outs = []
    for n in (0, 1, 1, 2, 3, 3):
        rows = spark.createDataFrame([(i, k, k) for i, k in enumerate(batches[n])], "id int, k string, text string")
        outs.append((n, kept.memoised(table, n, rows, compute(n), ["text"])))
    assert sorted(asked, key=str) == sorted([(0, "a"), (0, "bb"), (0, None), (1, "ccc"), (3, "dddd")], key=str)
    first = {}
    for n, out in outs:
        for k in batches[n]:
            first.setdefault(k, n)
        want = [(i, k, k, len(k) if k else None, first[k], first[k] < n) for i, k in enumerate(batches[n])]
        assert sorted((tuple(r) for r in out.select("id", "k", "text", "n", "by", "hit").collect())) == want


def test_a_stream_that_starts_again_repeats_no_batch(spark, tmp_path):
    folder, checkpoint = f"file://{tmp_path}/in", f"file://{tmp_path}/checkpoint"
    table, rows, fall = new(spark, tmp_path), [], [True]

    def take(batch, number):
        table.commit(number, batch)
        if number == 1 and fall.pop():  # committed, but the stream's own log doesn't know yet
            raise RuntimeError("falls over")
        fall.append(False)
        table.compact()

    def run():
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder).writeStream.foreachBatch(take).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()

    for n in range(3):
        rows += made(n, 40)
        spark.createDataFrame(made(n, 40), SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        fall[:] = [n == 1]
        if n == 1:
            with pytest.raises(Exception, match="falls over"):
                run()
            fall[:] = [False]
        run()
        assert got(table.read()) == plain(rows)
    assert table.committed() == [0, 1, 2]
