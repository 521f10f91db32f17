"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where the tables that are written at the moment are listed, the innermost :func:`scratch` last.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Only where it is unset and all of Spark runs in one process (tests) a
    temporary one is taken; on a cluster RuntimeError, as executors would not
    see each other's files.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folder(spark: SparkSession, label: str) -> str:
    """A path that is still free in the shared folder; what is written there goes as :func:`materialize` says."""
    path = f"{shared_dir(spark)}/textloom-{label}-{uuid.uuid4().hex}"
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: it survives the loss of executors.

    The table goes with the enclosing :func:`scratch`, or else when the application ends.
    """
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        files, at = _file_system(spark, path)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that are materialized within are deleted at its end, so that what is read from them has to be written by then.

    A table whose path is taken from the list stays.
    """
    _OPEN.append([])
    try:
        yield _OPEN[-1]
    finally:
        drop(spark, _OPEN.pop())


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What one action shuffles is removed when it ends, not when the driver happens to collect its plan."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settled(spark: SparkSession, make, label: str) -> DataFrame:
    """The result of make() as a table; the tables that were needed for it are deleted."""
    with scratch(spark) as paths:
        out = materialize(make(), label)
        kept = paths.pop()
    if _OPEN:
        _OPEN[-1].append(kept)
    return out
