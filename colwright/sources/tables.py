"""Table sources, sinks and previews."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colwright.columns import col, fresh_name, require


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options: str | bool) -> DataFrame:
    """CSV with a header row; `options` go to Spark's reader (`multiLine=True, escape='"'` for text with line breaks).

    Without a schema the types are inferred, which reads the file once more: give
    one for large files.
    """
    reader = spark.read.options(**{"header": True, **options})
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_table(
    df: DataFrame,
    path: str,
    *,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    rebalance: bool | None = None,
) -> None:
    """Write the table as parquet.

    A partitioned table is rebalanced on the partition columns first, else every
    task would write a file into every folder. Adaptive execution sizes the
    resulting partitions: it merges small ones and splits that of a hot value.
    `rebalance` decides otherwise.

    Overwriting replaces the whole table, and only once the new one is complete: it is written beside
    the old one and takes its place by renaming. So a table may be read, changed and saved over itself,
    and a write that fails leaves the old rows. Tables read from the path before have to be read again. If the driver is lost
    between the two renames, `restore_table` brings the old rows back.
    """
    require(df, *partition_by)
    if partition_by if rebalance is None else rebalance:
        df = df.hint("rebalance", *[col(c) for c in partition_by])
    if mode != "overwrite":
        df.write.mode(mode).partitionBy(*partition_by).parquet(path)
        return
    spark = df.sparkSession
    restore_table(spark, path)
    target = _Place(spark, path)
    new = target.beside(f"new-{uuid.uuid4().hex}")
    try:
        df.write.partitionBy(*partition_by).parquet(new.uri)
        target.take_over(new)
    finally:
        new.delete()
    spark.catalog.refreshByPath(path)


def restore_table(spark: SparkSession, path: str) -> bool:
    """If the table is missing because an overwrite was cut off, put the old rows back; whether it was."""
    target = _Place(spark, path)
    if target.exists():
        return False
    olds = target.all_beside("old-*")
    return bool(olds) and olds[0].rename(target)


class _Place:
    """A path in whatever file system Spark finds it."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, jvm = spark, spark._jvm
        plain = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = plain.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = self._fs.makeQualified(plain)
        self.uri = self._path.toString()

    def beside(self, ending: str) -> _Place:
        """A hidden neighbour: readers of the folder above pass over it."""
        return _Place(self._spark, f"{self._path.getParent().toString().rstrip('/')}/.{self._path.getName()}.{ending}")

    def all_beside(self, ending: str) -> list[_Place]:
        found = self._fs.globStatus(self.beside(ending)._path) or []
        return [_Place(self._spark, s.getPath().toString()) for s in found]

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def delete(self) -> None:
        self._fs.delete(self._path, True)

    def rename(self, to: _Place) -> bool:
        return self._fs.rename(self._path, to._path)

    def take_over(self, new: _Place) -> None:
        old = self.beside(f"old-{uuid.uuid4().hex}")
        if self.exists() and not self.rename(old):
            raise OSError(f"cannot move {self.uri} aside")
        if not new.rename(self):
            old.rename(self)
            raise OSError(f"cannot move {new.uri} to {self.uri}")
        old.delete()


def _as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[col(c) for c in df.columns])).alias("row"))


def preview(df: DataFrame, n: int = 1000) -> DataFrame:
    """The first n rows, each as a JSON object in the column `row`."""
    return _as_json(df.limit(n))


def preview_random(df: DataFrame, n: int = 1000, seed: int | None = None) -> DataFrame:
    """n random rows, or all rows of a smaller table, each as a JSON object in the column `row`.

    The rows with the n smallest of independent random numbers, in one scan: each task keeps n rows, and those are
    merged. A lot is drawn per row, so every row has the same chance, wherever it lies.
    """
    lot = fresh_name(df, "__lot")
    drawn = df.withColumn(lot, F.rand() if seed is None else F.rand(seed)).orderBy(col(lot)).limit(n)
    return _as_json(drawn.select(*[col(c) for c in df.columns]))
