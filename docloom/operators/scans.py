"""Running values over ordered keys of any size: the segmented scan.

A key's rows usually fit one window. Where some key has more than ``WINDOW_ROWS`` rows, rows are dealt by ranges of
(key, order), so that a key of any size spreads over many pieces; a first pass gives one row a piece and key, the carries run
over those, and a second pass adds them. At most one key a piece goes on from the piece before, so there are no
more carries than pieces. Both ways give the same rows. The order must end in a tie-breaker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import storage

#: Rows of one key that a single window may hold, and the largest share of all rows that a piece takes (1 / PIECES), less where Spark's own setting says so.
WINDOW_ROWS = 1_000_000
PIECES = 32

_UPTO = (Window.unboundedPreceding, 0)


def hot(df: DataFrame, keys: list[str], most: int | None = None) -> bool:
    """Whether some key has more rows than one window may hold."""
    row = df.groupBy(*keys).agg(F.count("*").alias("rows of a key")).agg(F.max("rows of a key")).first()
    return (row[0] or 0) > (WINDOW_ROWS if most is None else most)


def pieced(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The rows, written once, with the number of their range of (key, order) as ``piece``."""
    n = max(PIECES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return storage.table(df.repartitionByRange(n, *keys, *order).withColumn("piece", F.spark_partition_id()), "pieces")


def _values(sums: dict[str, Column], lasts: dict[str, Column], lags: dict[str, Column], w) -> list[Column]:
    """Within a window: running sums, last values that are not null, and values of the row before."""
    upto = w.rowsBetween(*_UPTO)
    each = [F.sum(c).over(upto).alias(n) for n, c in sums.items()]
    each += [F.last(c, ignorenulls=True).over(upto).alias(n) for n, c in lasts.items()]
    return each + [F.lag(c).over(w).alias(n) for n, c in lags.items()]


def scan(df: DataFrame, keys: list[str], order: list, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, spread: bool | None = None) -> DataFrame:
    """The rows with, per key in order and up to the row itself: sums, last values that are not null; and values of the row before.

    ``spread`` chooses pieces (True) or one window a key (False); without it the largest key decides.
    """
    sums, lasts, lags = sums or {}, lasts or {}, lags or {}
    if spread is None:
        spread = hot(df, keys)
    if not spread:
        return df.select("*", *_values(sums, lasts, lags, Window.partitionBy(*keys).orderBy(*order)))
    w = Window.partitionBy("piece", *keys).orderBy(*order)
    raw = {f"row {n}": c for n, c in lags.items()}
    local = pieced(df, keys, order).select("*", *_values(sums, lasts, lags, w), *(c.alias(n) for n, c in raw.items()), F.row_number().over(w).alias("place"))
    names = [*sums, *lasts, *raw]
    ends = local.groupBy("piece", *keys).agg(F.max_by(F.struct(F.lit(0).alias("-"), *names), "place").alias("end")).select("piece", *keys, *(F.col(f"end.`{n}`").alias(n) for n in names))
    over = Window.partitionBy(*keys).orderBy("piece")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(n).over(before) for n in sums] + [F.last(n, ignorenulls=True).over(before) for n in lasts] + [F.lag(n).over(over) for n in raw]
    carries = ends.select(F.col("piece").alias("late piece"), *(F.col(k).alias(f"late {k}") for k in keys), F.row_number().over(over).alias("late at"), *(c.alias(f"carried {n}") for c, n in zip(carried, names, strict=True))).filter("`late at` > 1")
    same = F.col("piece") == F.col("late piece")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"late {k}"))
    joined = local.join(carries, same, "left")
    whole = {n: F.when(F.col(f"carried {n}").isNotNull(), F.coalesce(F.col(n), F.lit(0)) + F.col(f"carried {n}")).otherwise(F.col(n)) for n in sums}
    whole |= {n: F.coalesce(n, f"carried {n}") for n in lasts}
    whole |= {n: F.when(F.col("place") == 1, F.col(f"carried row {n}")).otherwise(F.col(n)) for n in lags}
    return joined.select(*(F.col(c) for c in df.columns), *(c.alias(n) for n, c in whole.items()))
