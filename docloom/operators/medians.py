"""Exact medians of keys of any size: histograms narrow a key down to the values around its middle, and only those are ordered.

A round takes a value's share of what is left of its key's range by its leading bits, the exponent and 256 steps of the mantissa, counts values by these with map-side
sums, and keeps the part that holds the middle. Values that crowd to the low end fall apart by exponents as even ones do by steps; the smallest and the largest value have
parts of their own, so every round leaves fewer values, infinities included. Rounds end once no key has more than ``scans.WINDOW_ROWS`` distinct values left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import storage
from docloom.operators import scans

STEPS = 256
LEAST_EXPONENT = -1022


def _same(keys: list[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"counted.`{k}`").eqNullSafe(F.col(f"span.`{k}`")) for k in keys))


def _within(counted: DataFrame, span: DataFrame, keys: list[str]) -> DataFrame:
    """The counted values that lie in their key's span, with that span."""
    both = counted.alias("counted").join(span.alias("span"), _same(keys))
    inside = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
    return both.filter(inside).select("counted.*", "span.lo", "span.hi", "span.below", "span.middle")


def _bin() -> Column:
    """The number of a value's part: 0 for the smallest, the last for the largest, rising in between; halves keep the width of a range finite."""
    half = lambda c: F.col(c).cast("double") / 2
    share = F.try_divide(half("v") - half("lo"), half("hi") - half("lo"))
    share = F.nanvl(F.coalesce(share, F.lit(0.5)), F.lit(0.5))
    exponent = F.greatest(F.coalesce(F.floor(F.log2(share)), F.lit(LEAST_EXPONENT)), F.lit(LEAST_EXPONENT))
    step = F.least(F.greatest(F.floor((share / F.pow(F.lit(2.0), exponent) - 1) * STEPS), F.lit(0)), F.lit(STEPS - 1))
    inner = 1 + (exponent - LEAST_EXPONENT) * STEPS + step
    return F.when(F.col("v") <= F.col("lo"), 0).when(F.col("v") >= F.col("hi"), (2 - LEAST_EXPONENT) * STEPS).otherwise(inner)


def _narrowed(counted: DataFrame, span: DataFrame, keys: list[str]) -> DataFrame:
    """Each key's span after a round: of its parts (a few thousand where values are even), the first up to which more values lie than the middle asks for."""
    parts = _within(counted, span, keys).groupBy(*keys, _bin().alias("bin")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("distinct"), F.first("below").alias("below"), F.first("middle").alias("middle"))
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    hit = parts.withColumn("upto", upto).filter(F.col("upto") > F.col("middle"))
    best = hit.groupBy(*keys).agg(F.min(F.struct("bin", "lo", "hi", (F.col("upto") - F.col("n")).alias("below"), "middle", "distinct")).alias("s"))
    return best.select(*keys, "s.lo", "s.hi", "s.below", "s.middle", "s.distinct")


def upper_medians(df: DataFrame, keys: list[str], value: str, name: str = "mid", spread: bool | None = None, most: int | None = None) -> DataFrame:
    """(keys, name): the upper middle value of each key, nulls left out; NaN is above every number, as in Spark's order.

    ``spread`` chooses rounds (True) or one window a key (False); without it the largest key decides. ``most`` is how many distinct values one window may order.
    """
    most = scans.WINDOW_ROWS if most is None else most
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    if spread is None:
        spread = scans.hot(df, keys, most)
    if not spread:
        sums = counted.withColumn("middle", F.floor(F.sum("n").over(Window.partitionBy(*keys)) / 2)).withColumn("below", F.lit(0))
        return _ordered(sums, keys, name)
    counted = storage.table(counted, "counted")
    span = counted.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.lit(0).cast("long").alias("below"), F.floor(F.sum("n") / 2).alias("middle"), F.count("*").alias("distinct"))
    span = storage.table(span, "spans")
    while span.filter(F.col("distinct") > most).limit(1).count():
        wide = F.col("distinct") > most
        before, span = span, storage.table(span.filter(~wide).unionByName(_narrowed(counted, span.filter(wide), keys)), "spans")
        storage.drop(before)
    return _ordered(_within(counted, span, keys), keys, name)


def _ordered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    upto = F.col("below") + F.sum("n").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", upto).filter(F.col("upto") > F.col("middle")).groupBy(*keys).agg(F.min("v").alias(name))
