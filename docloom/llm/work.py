"""Shared scratch space and sizing, common to the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.storage import drop, new_path, shared_dir, table

__all__ = ["drop", "groups", "input_bytes", "joined", "likely", "marked", "named", "new_path", "numbered", "row_key", "shared_dir", "table"]


def named(column: str) -> Column:
    """A column by its whole name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def numbered(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """The frame with its columns under plain names, and that of one of them: not every name can go through Arrow functions."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), f"c{df.columns.index(column)}"


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files below a frame, from the optimizer's statistics; without such, text is counted."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < 1 << 55:
        return size
    counted = df.select(*((F.octet_length(named(c)) if t in ("string", "binary") else F.lit(8)).alias(f"c{i}") for i, (c, t) in enumerate(df.dtypes)))
    row = counted.selectExpr("sum(" + " + ".join(f"coalesce({c}, 0)" for c in counted.columns) + ")").first()
    return int(row[0] or 0)


#: A null id in an order of ids: the largest.
NO_ID = (1 << 63) - 1


def row_key(id_column: str, text_column: str) -> tuple[Column, Column]:
    """(id, th) of a row: its id, or the largest number for a null, and a hash of its text. Rows that agree in both are copies."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)), F.xxhash64(F.col(text_column))


#: Bits of the map that ``likely`` broadcasts, in words of 64: 1 MB, whatever the input's size.
MAP_BITS = 1 << 22
MAYBE = "may occur"


def marked(df: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with one more column, MAYBE: whether their key columns may occur in ``wanted`` (true for all that do).

    The map has a fixed size; with many more keys it fills and says maybe to every row, so results never depend on it.
    """
    bit = F.pmod(F.xxhash64(*columns), F.lit(MAP_BITS))
    maps = wanted.select(bit.alias("map bit")).groupBy(F.shiftright("map bit", 6).alias("map word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(`map bit` & 63 AS INT))")).alias("map bits"))
    both = df.withColumn("map bit", bit).join(F.broadcast(maps), F.shiftright("map bit", 6) == F.col("map word"), "left")
    return both.select(*(df[c] for c in df.columns), F.coalesce(F.expr("(`map bits` & shiftleft(1L, CAST(`map bit` & 63 AS INT))) <> 0"), F.lit(False)).alias(MAYBE))


def likely(df: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``df`` whose key columns may occur in ``wanted``: before a join this keeps rows that can't match out of the shuffle."""
    return marked(df, wanted, columns).filter(F.col(MAYBE)).drop(MAYBE)


#: Keys that are joined by broadcast because they are hot, at most, and rows from which a key counts as hot.
HOT_KEYS, HOT_ROWS = 20_000, 200


def joined(rows: DataFrame, keys: DataFrame, on: list[str], weight: str) -> DataFrame:
    """Inner join of rows with a table of unique keys that says how many rows each has.

    Hot keys, at most HOT_KEYS by their weights, are broadcast, so their rows stay where they are; others are shuffled.
    """
    limit = max(HOT_ROWS, int(keys.agg(F.sum(weight)).first()[0] or 0) // HOT_KEYS)
    hot = keys.filter(F.col(weight) > limit)
    if hot.isEmpty():
        return rows.join(keys, on)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.filter(F.col(weight) <= limit), on)
    return cold.unionByName(rows.join(F.broadcast(hot), on))


def groups(df: DataFrame, group_bytes: int, least: int | None = None) -> int:
    """How many groups of about ``group_bytes`` of input a frame is dealt into."""
    least = least or 2 * df.sparkSession.sparkContext.defaultParallelism
    return max(least, -(-input_bytes(df) // group_bytes))
