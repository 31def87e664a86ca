"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of the tables that the innermost open ``scratch`` has seen written.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one is made only where the setting is
    absent, which is the case in tests on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result no longer depends on the tasks that made it, so an executor lost later costs no
    recomputation of what lies before, and both readers of a forked plan see the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if (open_ := _written.get()) is not None:
        open_.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder, through the file system that it lies in."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that are materialised within are removed at the end. The block gets a function that
    writes a table which stays: its result, which must not be read lazily from the others."""
    outer, own = _written.get(), []
    token = _written.set(own)

    def result(df: DataFrame, name: str = "result") -> DataFrame:
        inner = _written.set(outer)
        try:
            return materialise(df, name)
        finally:
            _written.reset(inner)

    try:
        yield result
    finally:
        _written.reset(token)
        for path in own:
            remove(spark, path)


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only when ``df`` is counted to hold at most ``rows`` rows; otherwise the
    join is left to shuffle. ``df`` should be cheap to count (a materialised table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
