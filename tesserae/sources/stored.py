"""Intermediate tables as Parquet in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from . import versions

#: What the process owns to its end, and what the innermost owner of this thread does.
_PROCESS: list[tuple[SparkSession, str]] = []
_OWNER: ContextVar[list[tuple[SparkSession, str]]] = ContextVar("tables", default=_PROCESS)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder; only a local master gets one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints"


def folder(spark: SparkSession, name: str = "") -> str:
    """A new folder's path, which goes with its owner."""
    path = f"{shared_folder(spark)}/tesserae-{uuid.uuid4().hex}{name and '-' + name}"
    _OWNER.get().append((spark, path))
    return path


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back: what several branches of a plan need is computed once and survives
    lost executors. The table goes with its owner: owned(), else the process."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reclaim(spark: SparkSession) -> None:
    """Let go of the shuffle files of what nothing holds any more: they stay until the driver's garbage is
    collected, and after a large write they are several times what was written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def owned():
    """Tables stored inside, by this thread, go at the end: what reads them must have been written by then."""
    token = _OWNER.set([])
    try:
        yield
    finally:
        _remove(_OWNER.get())
        _OWNER.reset(token)


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        context = spark.sparkContext
        if context._jsc is not None and not context._jsc.sc().isStopped():
            versions.delete(spark, path)


atexit.register(_remove, _PROCESS)
