"""Integer codes for the values of a column."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colwright.columns import col, fresh_name, move_after, type_of
from colwright.operators.joins import join_to_unique, splits_by_rows
from colwright.plans.fits import Fit, Params, fitted
from colwright.sources.shared import shared_path

def _value(df: DataFrame, column: str) -> Column:
    """The column with NaN counting as missing."""
    if isinstance(type_of(df, column), (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col(column)), col(column))
    return col(column)


@dataclass(frozen=True)
class Categories:
    """Fit of a category list: {"first", "table"}.

    `table` is the path of a parquet table of (value, rows, place), whatever its size. `first` is the lowest
    code: 0 if there are exactly two distinct values, counting null as one, else 1.
    """

    column: str

    def run(self, df: DataFrame) -> dict[str, Any]:
        """Number the distinct values in ascending order without a single-task window.

        They are range-partitioned and sorted, so that the row id holds the partition in its upper bits and the
        place within it below. The sorted values are written to the shared folder, because a range partitioning samples
        its bounds and all uses of the row ids must see the same one.
        """
        spark = df.sparkSession
        path = shared_path(spark, "categories")
        distinct = df.groupBy(_value(df, self.column).alias("value")).agg(F.count("*").alias("rows"))
        ranged = distinct.repartitionByRange("value").sortWithinPartitions("value")
        ranged.withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
        return {"first": 0 if spark.read.parquet(path).count() == 2 else 1, "table": path}


def _codes(table: DataFrame, first: int, name: str, code_name: str) -> DataFrame:
    """Running numbers from the row ids: the place within a partition plus all rows before it."""
    known = table.where(F.col("value").isNotNull()).withColumn("part", F.shiftright("place", 33))
    # One row per partition of the range exchange: safe for one task and for a broadcast.
    sizes = known.groupBy("part").agg(F.count("*").alias("size"), F.min("place").alias("start"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part", "start", F.coalesce(before, F.lit(0)).alias("before"))
    code = F.col("before") + F.col("place") - F.col("start") + first
    numbered = known.join(F.broadcast(offsets), "part")
    return numbered.select(F.col("value").alias(name), code.cast("bigint").alias(code_name))


def fit_categories(df: DataFrame, column: str) -> Fit:
    type_of(df, column)
    return {"categories": Categories(column)}


def encode_category(
    df: DataFrame,
    column: str,
    new_column: str,
    *,
    after: str | None = None,
    params: Params | None = None,
) -> DataFrame:
    """A bigint code per distinct value, in ascending order of the values; null stays null.

    Codes start at 0 if the column has exactly two distinct values, counting null
    as one, and at 1 otherwise. Fitting runs when the operator is called; values not
    seen by the fit get no code. Spark joins the codes by their kept size; rows of hot values are split in any case.
    """
    name = fresh_name(df, new_column)
    categories: Mapping[str, Any] = fitted(df, fit_categories(df, column), params)["categories"]
    held, code = fresh_name(df, "__value"), fresh_name(df, "__code")
    keyed = df.withColumn(held, _value(df, column))
    table = df.sparkSession.read.parquet(categories["table"])
    codes = _codes(table, int(categories["first"]), held, code)
    known = table.where(F.col("value").isNotNull())
    splits = fresh_name(df, "__splits")
    hot = splits_by_rows(known.select(F.col("value").alias(held), "rows"), "rows", splits)
    # A stream's rows cannot be numbered, and come in small batches.
    coded = keyed.join(codes, held, "left") if df.isStreaming else join_to_unique(keyed, codes, held, hot, splits)
    out = coded.select(*[col(c) for c in df.columns], col(code).alias(name))
    return out if after is None else move_after(out, [name], after)
