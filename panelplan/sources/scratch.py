"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the session's spark.checkpoint.dir.

    Where neither that nor a checkpoint folder is set, a local session (tests) gets a temporary one; a
    cluster must name its own, as its machines do not share their temporary folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


#: The folders made inside each open temporary(), innermost last.
_OPEN: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it is; nothing happens where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Folders made inside go at the end: for work whose result is written elsewhere before the end."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


#: Spark's setting that removes a query's shuffle files when it has ended, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df written to the shared folder (or a given path) and read back: what several branches need is computed once, and lineage ends there.

    Nothing reads the shuffles behind a written table again, so their files go at once."""
    spark = df.sparkSession
    path, before = path or scratch_dir(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the folder of a staged table that nothing reads any more."""
    remove(df.sparkSession, df.staged_path)
