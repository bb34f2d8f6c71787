"""Tables in the folder that driver and executors share: lineage ends there, and they go once nothing reads them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in tests a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/docloom-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def located(spark: SparkSession, path: str):
    """The file system of a path, and the path as that knows it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared one, deleted when the driver's JVM ends at the latest."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    fs, where = located(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


#: Tables that were written within each open scope of this thread, the innermost last.
_OPEN: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("open scopes", default=())


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """All tables that are written within go at its end, but for those put into the list that it gives."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    before = _OPEN.set((*_OPEN.get(), made))
    try:
        yield kept
    finally:
        _OPEN.reset(before)
        drop(*(t for t in made if not any(t is k for k in kept)))


def table(df: DataFrame, label: str) -> DataFrame:
    """Writes a frame as Parquet into the shared folder and reads it again: lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(f"{path}/t")
    out = spark.read.schema(df.schema).parquet(f"{path}/t")
    out._shared_path = path
    if scopes := _OPEN.get():
        scopes[-1].append(out)
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes the files of tables that no frame reads any more."""
    for t in tables:
        path = getattr(t, "_shared_path", None)
        if path:
            fs, where = located(t.sparkSession, path)
            fs.delete(where, True)
            fs.cancelDeleteOnExit(where)
            t._shared_path = None
