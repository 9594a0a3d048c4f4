"""Intermediate tables in the folder that all executors share, and how long they live."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); where that is unset, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="fluvia-"))
    return f"file://{_OWN_DIR[0]}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside the block go when it ends; results that read them must be used, or written with ``stays``, before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            remove(spark, path)


def written(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back, which cuts its lineage.

    A lost executor then costs only a reread. The folder goes at the end of the innermost ``scratch`` block unless it
    ``stays``, else by ``discard``, and at the latest when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fluvia/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _SCOPES and not stays:
        _SCOPES[-1].append(path)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        remove(df.sparkSession, file.rpartition("/")[0])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it lies."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session or its JVM has ended already
        return
