"""Arrow UDFs from plain functions over one row's values. Nulls stay null.

A batch becomes Python objects slice by slice, and what comes of a slice is given on before the next one: a task holds a batch of its input (which
Spark bounds by rows and by bytes), one slice as objects and one as Arrow, however many rows the batch, the partition or the table has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf


#: Bytes of input that a task holds as Python objects, with what comes of them.
SLICE_BYTES = 1 << 20


def slices(size: int, rows: int) -> Iterator[tuple[int, int]]:
    """(begin, rows) of slices of about SLICE_BYTES of a batch."""
    step = max(1, rows * SLICE_BYTES // max(size, 1))
    for at in range(0, rows, step):
        yield at, min(step, rows - at)


def _taken(out: list, kind: pa.DataType) -> pa.Array:
    """The results as Arrow; their objects go."""
    array = pa.array(out, kind)
    out.clear()
    return array


def in_slices(f: Callable, batches: Iterable[Sequence[pa.Array]], kind: pa.DataType) -> Iterator[pa.Array]:
    """What ``f`` makes of each row, null where a value is null. An array ends with its slice, or where its texts come to SLICE_BYTES characters, as rows differ in size."""
    for columns in batches:
        for at, n in slices(sum(c.nbytes for c in columns), len(columns[0])):
            out: list = []
            held = 0
            for row in zip(*(c.slice(at, n) for c in columns), strict=True):
                values = [v.as_py() for v in row]
                out.append(None if any(v is None for v in values) else f(*values))
                held += sum(len(v) for v in values if isinstance(v, str))
                if held >= SLICE_BYTES:
                    yield _taken(out, kind)
                    held = 0
            if out:
                yield _taken(out, kind)


def over_text(f: Callable, kind: str) -> Callable[..., Column]:
    """A function of columns that runs ``f`` on each row in which none of them is null. The UDF is made when it is first used, as its type needs a session."""
    made: list = []

    def call(*columns) -> Column:
        if not made:
            from pyspark.sql.pandas.types import to_arrow_type
            from pyspark.sql.types import _parse_datatype_string

            declared = _parse_datatype_string(kind)
            arrow = to_arrow_type(declared)

            @arrow_udf(declared)
            def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
                return in_slices(f, ((x,) for x in batches), arrow)

            @arrow_udf(declared)
            def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
                return in_slices(f, batches, arrow)

            made.extend((one, two))
        return made[len(columns) - 1](*columns)

    return call
