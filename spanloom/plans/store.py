"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it names none, a local folder is made on a local master; on a cluster
    that is an error, as executors wouldn't see it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"spanloom-{uuid.uuid4().hex[:8]}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (held := _scratch.get()) is not None:
        held.append(path)
    return path


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a path of any store."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    fs, found = hadoop(spark, path)
    return fs.exists(found)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, found = hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(found)) if fs.exists(found) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, found = hadoop(spark, path)
    fs.delete(found, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialised within are deleted at the end: for work whose results are written elsewhere."""
    token = _scratch.set([])
    try:
        yield
    finally:
        for path in _scratch.get():
            delete(spark, path)
        _scratch.reset(token)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage is cut and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str, **counts) -> tuple[DataFrame, dict[str, int]]:
    """The same, with aggregates of the rows that are taken while they are written."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = materialize(df.observe(seen, *(c.alias(k) for k, c in counts.items())), name)
    return out, seen.get
