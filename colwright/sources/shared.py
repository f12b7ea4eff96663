"""Tables that an operator has to keep, in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# The lists of paths that open owners are to remove, the innermost last.
_owned: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the session's `spark.checkpoint.dir`.

    A local session without that setting keeps its tables beside its own, in the warehouse. On a cluster the setting is needed:
    nothing is ever kept in a folder of one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_kept"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _owned:
        _owned[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def owned_tables(spark: SparkSession) -> Iterator[None]:
    """Owns the tables that operators keep inside the block, and removes them at its end.

    Results that were not written, collected or saved by then can't be computed any more. Blocks may be nested.
    """
    _owned.append([])
    try:
        yield
    finally:
        for path in _owned.pop():
            remove(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that every use sees the same rows."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def briefly_kept(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A kept table for jobs that run inside the block; it is removed afterwards."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)


def remove_kept(df: DataFrame) -> None:
    """Remove a kept table, once whatever was made from it has been written."""
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        remove(df.sparkSession, folder)
