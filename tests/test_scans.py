"""Segmented scans and packing by jumps against one window or fold a key, with a key that holds most rows."""

import random

import numpy as np
import pytest
from docloom.operators import scans, windows
from pyspark.sql import functions as F


def rows_of(spark, n=3000, seed=3):
    """One key has nine tenths of the rows; keys, values and flags may be null."""
    r = random.Random(seed)
    data = [(7 if r.random() < 0.9 else r.choice([1, 2, None]), i, r.choice([None, 1, 2, 3]), r.random() < 0.1, r.choice(["", "1", "2.", "x"]), r.choice(["", "y"])) for i in range(n)]
    r.shuffle(data)
    return spark.createDataFrame(data, "k int, at long, v int, flag boolean, s string, t string")


def same(a, b):
    key = lambda r: tuple(str(x) for x in r)
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert sorted(map(tuple, a.select(*columns).collect()), key=key) == sorted(map(tuple, b.select(*columns).collect()), key=key)


SCANS = {
    "scan": lambda d, s: scans.scan(d, ["k"], ["at"], sums={"total": F.col("v"), "n": F.lit(1)}, lasts={"last": F.col("v")}, lags={"before": F.col("v"), "one": F.lit(1)}, spread=s),
    "two keys": lambda d, s: scans.scan(d, ["k", "flag"], [F.desc("at")], sums={"n": F.lit(1)}, spread=s),
    "runs": lambda d, s: windows.runs(d, ["k"], ["at"], F.col("flag"), spread=s),
    "value_runs": lambda d, s: windows.value_runs(d, ["k"], ["at"], "v", spread=s),
    "islands": lambda d, s: windows.islands(d.filter("at % 7 > 1"), ["k"], "at", 1.0, spread=s),
    "carried": lambda d, s: windows.carried(d, ["k"], ["at"], F.col("flag"), F.col("v") > 1, "at", spread=s),
    "filled": lambda d, s: windows.filled(d, ["k"], ["at"], "v", spread=s),
    "renumbered": lambda d, s: windows.renumbered(d, ["k"], ["at"], F.col("flag"), spread=s),
    "leading": lambda d, s: windows.leading(d, ["k"], ["at"], F.col("at") < 2000, spread=s),
    "continued": lambda d, s: windows.continued(d, ["k"], "at", "s", ["t"], spread=s),
    "serial_merges": lambda d, s: windows.serial_merges(d, ["k"], "at", "s", "t", spread=s),
    "merged_runs": lambda d, s: windows.merged_runs(d, ["k"], "at", ["flag"], "t", spread=s),
}


@pytest.mark.parametrize("name", SCANS)
def test_pieces_equal_one_window(spark, name):
    df = rows_of(spark)
    same(SCANS[name](df, True), SCANS[name](df, False))
    assert SCANS[name](df.limit(0), True).collect() == []


def test_the_largest_key_decides(spark, monkeypatch):
    df, seen = rows_of(spark, 300), []
    monkeypatch.setattr(scans, "pieced", lambda d, k, o, made=scans.pieced: seen.append(1) or made(d, k, o))
    windows.filled(df, ["k"], ["at"], "v", spread=None)
    assert not seen
    monkeypatch.setattr(scans, "WINDOW_ROWS", 100)
    windows.filled(df, ["k"], ["at"], "v", spread=None)
    assert seen


def test_pieces_of_a_hot_key_are_even(spark):
    sizes = [r["count"] for r in scans.pieced(rows_of(spark, 20_000), ["k"], ["at"]).groupBy("piece").count().collect()]
    assert len(sizes) > 20 and max(sizes) <= 2 * float(np.median(sizes))


def test_serial_merges_by_hand(spark):
    df = spark.createDataFrame([(1, i, s, t) for i, (s, t) in enumerate([("", "a"), ("1", "b"), ("", "c"), ("x", ""), ("", "d"), ("২.", ""), ("3)", ""), ("", ""), ("", "e")])], "k int, at int, s string, t string")
    got = [r["vmerge"] for r in windows.serial_merges(df, ["k"], "at", "s", "t").orderBy("at").collect()]
    assert got == [None, "restart", "continue", None, "continue", None, "restart", None, "continue"]


@pytest.mark.parametrize(("walk", "items", "most"), [(16, 4, 50), (64, 8, 30), (8, 1, 10), (40, 10, 100_000), (16, 4, 0)])
def test_packed_by_jumps_equals_the_fold(spark, monkeypatch, walk, items, most):
    r = random.Random(walk)
    rows = [(k, i, r.choice([0, 0, 1, 5, 9, 40, 200, None])) for k, n in (("a", 1500), ("b", 90), (None, 40), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, at long, size long")
    monkeypatch.setattr(windows, "WALK", walk)
    folded = windows.packed(df, "k", "at", "size", items, most)
    monkeypatch.setattr(windows, "FOLD_ROWS", 100)
    same(windows.packed(df, "k", "at", "size", items, most), folded)
    held = {}
    for k, _, chunk in sorted(map(tuple, folded.collect()), key=lambda x: (str(x[0]), x[1])):
        held.setdefault(k, []).append(chunk)
    for k, chunks in held.items():  # against the rule itself
        want, n, total, c = [], 0, 0, 0
        for _, _, size in [x for x in rows if x[0] == k]:
            if not c or n >= items or total + (size or 0) > most:
                c, n, total = c + 1, 0, 0
            n, total = n + 1, total + (size or 0)
            want.append(c)
        assert chunks == want
