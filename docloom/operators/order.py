"""How well a text keeps the order of another: the text it was copied from, the longest common sequence, and how far lines moved."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.medians import upper_medians

WORDS = r"[^ \t\n\x0B\f\r]+"


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence.

    What both begin and end with goes first, then what one side alone has. The rest is a longest increasing chain over the places
    of equal items, by patience piles, where there are few such places (each item once: n log n); where items repeat so often that their
    pairs outnumber the machine words of a table of bits, it is that table, a row a step. Both give the same number.
    """
    n, lo = min(len(a), len(b)), 0
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    shared = set(a) & set(b)
    a, b = [x for x in a if x in shared], [x for x in b if x in shared]
    places: dict = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    met = sum(len(places[x]) for x in a)
    chain = _chain(a, places) if met <= 4 * (len(a) + len(b)) + len(a) * len(b) // 512 else _bits(a, places, len(b))
    return lo + hi + chain


def _chain(a: list, places: dict) -> int:
    """Patience piles: tops[k] is the smallest place at which a chain of k + 1 ends; an item's places are played last to first, so it is used once."""
    tops: list[int] = []
    for x in a:
        for j in reversed(places[x]):
            k = bisect_left(tops, j)
            tops[k : k + 1] = [j]
    return len(tops)


def _bits(a: list, places: dict, n: int) -> int:
    """A row of the table of common lengths as one integer: a bit that is off is a step up."""
    full = (1 << n) - 1
    masks = {}
    for x, at in places.items():
        held = bytearray((n + 7) // 8)
        for j in at:
            held[j >> 3] |= 1 << (j & 7)
        masks[x] = int.from_bytes(held, "little")
    row = full
    for x in a:
        up = row & masks[x]
        row = ((row + up) | (row - up)) & full
    return n - row.bit_count()


def _ordered(truth: pd.Series, out: pd.Series) -> pd.DataFrame:
    rows = [(len(a), common_length(a, b)) for a, b in zip((t.split() if t else [] for t in truth), (t.split() if t else [] for t in out), strict=True)]
    return pd.DataFrame(rows, columns=["total", "ordered"])


def order_scores(pairs: DataFrame, truth: str, out: str) -> DataFrame:
    """The pairs with ``total`` (the words of ``truth``), ``ordered`` (how many of them ``out`` has in this order) and ``order_score``, 1 for a text without words."""
    # one kind of white space, so that words are the same here and in the kernel
    plain = lambda c: F.array_join(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(WORDS), 0), "\n")
    measured = F.pandas_udf(_ordered, "struct<total long, ordered long>")
    scored = pairs.withColumn("order of words", measured(plain(truth), plain(out)))
    total, ordered = F.col("order of words.total"), F.col("order of words.ordered")
    return scored.select(*(F.col(f"`{c}`") for c in pairs.columns), total.alias("total"), ordered.alias("ordered"), F.when(total == 0, 1.0).otherwise(ordered / total).alias("order_score"))


def lines(docs: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """(key, group, pos, line): trimmed lines that are not blank, numbered from 0 by their place among all lines."""
    rows = docs.select(key, group, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.withColumn("line", F.trim("line")).filter("line <> ''")


def bases(lined: DataFrame, key: str, group: str) -> DataFrame:
    """(key, base, shared): of the documents that were the first of their group with a line, the one that was so for most lines of a later document; ties go to the smallest.

    Every line asks for its first holder alone, so rows grow with the lines, never with pairs of documents; a document without earlier lines, or without a group, has no base.
    """
    line = F.struct(F.xxhash64("line"), F.xxhash64(F.reverse("line")), F.length("line"))
    short = lined.select(key, group, line.alias("line"))
    first = short.groupBy(group, "line").agg(F.min(key).alias("base"))
    votes = short.join(first, [group, "line"]).filter(F.col("base") < F.col(key)).groupBy(key, "base").agg(F.count("*").alias("shared"))
    return votes.groupBy(key).agg(F.max_by(F.struct("base", "shared"), F.struct("shared", -F.col("base"))).alias("best")).select(key, "best.base", "best.shared")


def moved_lines(lined: DataFrame, based: DataFrame, key: str) -> DataFrame:
    """(key, base, matched, mean_moved, median_moved): lines that both a document and its base hold once, and how many places apart they are (mean and upper middle)."""
    once = lined.groupBy(key, "line").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).filter("n = 1").drop("n")
    mine = based.select(key, "base").join(once, key)
    met = mine.join(once.select(F.col(key).alias("base"), "line", F.col("pos").alias("was")), ["base", "line"])
    moved = met.select(key, "base", F.abs(F.col("pos") - F.col("was")).cast("double").alias("moved"))
    means = moved.groupBy(key, "base").agg(F.count("*").alias("matched"), F.avg("moved").alias("mean_moved"))
    return means.join(upper_medians(moved, [key, "base"], "moved", "median_moved", spread=False), [key, "base"])
