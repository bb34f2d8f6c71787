"""A keyed table that batches are committed to: each batch once, however often it comes, the latest row of a key wins.

Files lie in ``kept_kind=delta|snapshot/kept_number=N/kept_bucket=B`` as Parquet. A batch is written to a folder named by its number and counts from the
moment at which its marker exists; a batch that fell over before leaves files that the next attempt overwrites, and one that comes again is left as it
is. Compaction folds what is committed into a snapshot and takes away what only readers of the snapshot before it needed. One writer at a time, as
``foreachBatch`` has it; readers need no lock.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import storage
from docloom.operators import windows

#: Columns of the folders; rows may not bring columns of these names.
PARTS = ("kept_kind", "kept_number", "kept_bucket")


@dataclass
class Kept:
    """Rows by ``keys`` at ``path``; ``order`` says which row of a key is the latest (a later batch wins ties).

    ``buckets`` must stay what it was when the first batch came. With ``most`` = (owner columns, time column, seconds, count, tie column), of an
    owner's rows the newest ``count`` stay of those that are at most so many seconds older than the newest row of all. What falls out never
    comes back, as rows only get newer, so compaction may drop it for good.

    Defined results: null keys are a key; a null in ``order`` is older than anything; an empty batch is committed like others.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: list[str]
    order: list[str]
    buckets: int = 64
    most: tuple[list[str], str, int, int, str] | None = None
    _fields: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self._fields = self.spark.createDataFrame([], self.schema).columns
        if clash := set(PARTS) & set(self._fields):
            raise ValueError(f"columns of the folders: {sorted(clash)}")

    # --- commits ------------------------------------------------------------------------------------------

    def _marks(self, kind: str) -> list[int]:
        fs, where = storage.located(self.spark, f"{self.path}/_commits")
        if not fs.exists(where):
            return []
        names = (f.getPath().getName().split("-") for f in fs.listStatus(where))
        return sorted(int(n[1]) for n in names if n[0] == kind)

    def committed(self) -> list[int]:
        """Numbers of the batches that count, those that a snapshot holds included."""
        return self._marks("delta")

    def _write(self, kind: str, number: int, rows: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        placed = rows.withColumn("kept_bucket", bucket)
        placed.repartition(self.buckets, "kept_bucket").write.mode("overwrite").partitionBy("kept_bucket").parquet(self._at(kind, number))
        fs, mark = storage.located(self.spark, f"{self.path}/_commits/{kind}-{number}")
        fs.create(mark, True).close()

    def _at(self, kind: str, number: int) -> str:
        return f"{self.path}/kept_kind={kind}/kept_number={number}"

    def commit(self, number: int, rows: DataFrame) -> bool:
        """Takes in the rows of a batch; false, and nothing else, if that batch has been taken in before."""
        if number in self.committed():
            return False
        held = rows.select(*self._fields)
        self._write("delta", number, self._latest(held.withColumn("kept_number", F.lit(number))))
        return True

    # --- reading ------------------------------------------------------------------------------------------

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row a key, its columns as they were; equal (order, number) are settled by the row's hash, so repeated rows give the same."""
        rest = [c for c in self._fields if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.order, "kept_number", F.xxhash64(*rest))).alias("kept row"))
        return best.select(*(F.col(c) if c in self.keys else F.col(f"kept row.{c}") for c in self._fields))

    def _files(self, before: int | None) -> list[str]:
        end = float("inf") if before is None else before
        snapshot = max((n for n in self._marks("snapshot") if n < end), default=None)
        gone = max(self._marks("gone"), default=-1)
        if snapshot is None and any(n < end and n <= gone for n in self.committed()):
            raise ValueError(f"batches before {before} were folded into a later snapshot")
        deltas = [n for n in self.committed() if n < end and (snapshot is None or n > snapshot)]
        paths = [self._at("delta", n) for n in deltas] + ([] if snapshot is None else [self._at("snapshot", snapshot)])
        # an empty batch has no buckets, and a folder without files is none that can be read
        return [p for p in paths if self._filled(p)]

    def _filled(self, path: str) -> bool:
        fs, where = storage.located(self.spark, path)
        return fs.exists(where) and any(f.isDirectory() for f in fs.listStatus(where))

    def read(self, before: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """The latest rows, of batches below ``before`` if it is given; of the keys in ``wanted`` alone, only their buckets are read.

        What a reader has got stays as it is while later batches come; two compactions later its files are gone.
        """
        paths = self._files(before)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, kept_kind string, kept_number long, kept_bucket int").option("basePath", self.path).parquet(*paths)
        if wanted is not None:
            sought = wanted.select(*self.keys).distinct()
            numbers = sought.select(F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("b")).distinct()
            # at most as many numbers as there are buckets come to the driver; the scan then opens their folders alone
            rows = rows.filter(F.col("kept_bucket").isin([r.b for r in numbers.collect()]))
            rows = rows.alias("kept").join(sought.alias("sought"), reduce(Column.__and__, (F.col(f"kept.`{k}`").eqNullSafe(F.col(f"sought.`{k}`")) for k in self.keys)), "left_semi")
        out = self._latest(rows)
        return out if self.most is None or wanted is not None else self._retained(out)

    def _retained(self, rows: DataFrame) -> DataFrame:
        owner, at, seconds, count, tie = self.most
        now = rows.agg(F.max(at)).first()[0]
        return windows.retained(rows, owner, at, F.lit(now), seconds, count, tie)

    # --- compaction ---------------------------------------------------------------------------------------

    def compact(self) -> None:
        """Folds all committed batches into a snapshot. Files that the snapshot before covers go; those since then stay for readers at work and for batches that come again."""
        done, snapshots = self.committed(), self._marks("snapshot")
        if not done or done[-1] in snapshots:
            return
        self._write("snapshot", done[-1], self.read())
        if not snapshots:
            return
        fs, _ = storage.located(self.spark, self.path)
        _, gone = storage.located(self.spark, f"{self.path}/_commits/gone-{snapshots[-1]}")
        fs.create(gone, True).close()
        for kind, numbers in (("delta", [n for n in done if n <= snapshots[-1]]), ("snapshot", snapshots[:-1])):
            for n in numbers:
                _, folder = storage.located(self.spark, self._at(kind, n))
                fs.delete(folder, True)
        for n in snapshots[:-1]:
            _, mark = storage.located(self.spark, f"{self.path}/_commits/snapshot-{n}")
            fs.delete(mark, False)


def memoised(kept: Kept, number: int, rows: DataFrame, compute: Callable[[DataFrame], DataFrame], inputs: list[str]) -> DataFrame:
    """The rows with what is kept for their keys, and ``hit``: whether an earlier batch had made it.

    ``compute`` gets one row (keys and ``inputs``) of each key that no earlier batch has, and returns rows for ``kept``; these are committed as batch ``number``.
    A batch that comes again finds its own rows committed: it computes nothing and gives what it gave. ``inputs`` are functions of the keys.
    """
    same = lambda a, b: reduce(Column.__and__, (F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in kept.keys))
    asked = storage.table(rows.select(*kept.keys).distinct(), "asked")
    known = kept.read(before=number, wanted=asked)
    if number not in kept.committed():
        missing = asked.alias("asked").join(known.select(*kept.keys).alias("known"), same("asked", "known"), "left_anti")
        fresh = rows.select(*kept.keys, *inputs).alias("rows").join(missing.alias("missing"), same("rows", "missing"), "left_semi")
        kept.commit(number, compute(fresh.dropDuplicates(kept.keys)))
    made = kept.read(before=number + 1, wanted=asked).alias("made")
    earlier = known.select(*kept.keys, F.lit(True).alias("was there")).alias("known")
    both = made.join(earlier, same("made", "known"), "left").select("made.*", F.coalesce("was there", F.lit(False)).alias("hit"))
    rest = [c for c in both.columns if c not in kept.keys]
    return rows.alias("asked").join(both.alias("found"), same("asked", "found"), "left").select("asked.*", *(F.col(f"found.`{c}`") for c in rest))
