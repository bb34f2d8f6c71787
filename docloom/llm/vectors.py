"""Vectors as whole numbers, and exact sums of them, common to clustering and code compression.

A component beyond ``REACH`` makes its vector a wide one: it travels as decimal strings and is computed with Python's
integers, one by one. All others are int32 and are computed in blocks; their squared distances fit 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 1 << 25
#: Exact sums travel as digits of this base, so that Spark adds longs.
DIGIT_BITS = 32
LONG = (1 << 63) - 1


def whole_numbers(scale: int, width: int):
    """(id, label, embedding) batches to (id, label, q, wide) of the vectors with ``width`` finite components: floor(scale * x), scale a power of two."""
    bits = scale.bit_length() - 1

    def wide(values: np.ndarray) -> list[str]:
        out = []
        for v in values.tolist():
            top, bottom = v.as_integer_ratio()
            out.append(str((top << bits) // bottom))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            if pa.types.is_large_list(column.type):
                column = column.cast(pa.list_(column.type.value_type))
            lengths = np.asarray(column.value_lengths().fill_null(-1))
            offsets = np.asarray(column.offsets)[:-1].astype(np.int64)
            rows = np.flatnonzero(lengths == width)
            values = column.values.cast(pa.float64())
            flat = np.asarray(values.fill_null(math.nan))
            x = flat[offsets[rows, None] + np.arange(width)] if len(rows) else np.zeros((0, width))
            sound = np.isfinite(x).all(axis=1)
            rows, x = rows[sound], x[sound]
            with np.errstate(over="ignore"):
                q = np.floor(x * scale)
            small = (np.abs(q) < REACH).all(axis=1)
            ints = np.where(small[:, None], q, 0).astype(np.int32)
            kept = pa.array(rows)
            far = [None if s else wide(v) for s, v in zip(small.tolist(), x, strict=True)]
            q_column = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(rows) + 1) * width, width), pa.int32()), pa.array(ints.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(kept), batch.column("label").take(kept), q_column, pa.array(far, pa.list_(pa.string()))], names=["vec_id", "label", "q", "wide"])

    return run


def prepared(vectors: DataFrame, scale: int, width: int) -> DataFrame:
    """(vec_id, label, q, wide) of the vectors that are kept; a table without labels has null ones."""
    label = F.col("label").cast("long") if "label" in vectors.columns else F.lit(None).cast("long")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(whole_numbers(scale, width), "vec_id long, label long, q array<int>, wide array<string>")


def matrices(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows of ordinary vectors, their matrix, rows of wide ones, their matrix of Python integers)."""
    wide = batch.column("wide")
    is_wide = np.asarray(wide.is_valid())
    q = np.asarray(batch.column("q").flatten()).reshape(len(batch), width).astype(np.int64)
    near, far = np.flatnonzero(~is_wide), np.flatnonzero(is_wide)
    # an array of objects is filled value by value, as numpy would turn small ones into doubles
    out = np.empty((len(far), width), object)
    for k, i in enumerate(far):
        out[k] = [int(v) for v in wide[int(i)].as_py()]
    return near, q[near], far, out


def plain(row) -> list[int]:
    """The integers of a row of ``prepared``."""
    return [int(v) for v in row["wide"]] if row["wide"] is not None else list(row["q"])


def integers(rows: list[list[int]]) -> np.ndarray:
    """A matrix that holds them exactly: of 64 bits where all are small."""
    small = all(abs(v) < REACH * 2 for r in rows for v in r)
    out = np.empty((len(rows), len(rows[0]) if rows else 0), np.int64 if small else object)
    for k, r in enumerate(rows):
        out[k] = r
    return out


def digits(n: int) -> list[int]:
    """A whole number in base 2**DIGIT_BITS, lowest first, all of its sign."""
    sign, n, out = (-1 if n < 0 else 1), abs(n), []
    while n:
        out.append(sign * (n & ((1 << DIGIT_BITS) - 1)))
        n >>= DIGIT_BITS
    return out


SUMS = "place int, digit int, part long"


def sum_rows(sums: dict[int, int]) -> pa.RecordBatch:
    """Exact sums by place as rows of SUMS."""
    found = [(p, k, d) for p, n in sums.items() for k, d in enumerate(digits(int(n))) if d]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.int32()), pa.array([r[2] for r in found], pa.int64())], names=["place", "digit", "part"])


def totals(parts: DataFrame) -> dict[int, int]:
    """Sums by place over all tasks: as many rows as places and digits, whatever the input."""
    out: dict[int, int] = {}
    for r in parts.groupBy("place", "digit").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        out[r["place"]] = out.get(r["place"], 0) + (int(r["total"]) << (DIGIT_BITS * r["digit"]))
    return out


def as_long(n: int) -> int | None:
    return n if -LONG - 1 <= n <= LONG else None
