"""The registered queries: every operator on the test tables, next to the SQL that must give the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder, read when asked for: `tables.orders`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(key: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable]:
    """Register a function of the tables under a key, with its SQL counterpart."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        QUERIES[key] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[key] = sql
        return build

    return register


# Importing the modules registers their queries.
from workload import columns, filters, fitted, ordering, recipes, values  # noqa: E402,F401
