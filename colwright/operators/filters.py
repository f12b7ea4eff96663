"""Row filters. Each is one predicate on a bare column, so it reaches the parquet reader."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from colwright.columns import col, literal_for, require


def filter_equal(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Keep rows equal to the value, or to any value of a list."""
    require(df, column)
    if isinstance(value, (list, tuple, set, frozenset)):
        return df.where(col(column).isin(*[literal_for(df, column, v) for v in value]))
    return df.where(col(column) == literal_for(df, column, value))


def filter_not_equal(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Keep rows that differ from the value; nulls go as well."""
    return df.where(col(column) != literal_for(df, column, value))


def filter_greater(df: DataFrame, column: str, value: Any) -> DataFrame:
    return df.where(col(column) > literal_for(df, column, value))


def filter_greater_equal(df: DataFrame, column: str, value: Any) -> DataFrame:
    return df.where(col(column) >= literal_for(df, column, value))


def filter_less(df: DataFrame, column: str, value: Any) -> DataFrame:
    return df.where(col(column) < literal_for(df, column, value))


def filter_less_equal(df: DataFrame, column: str, value: Any) -> DataFrame:
    return df.where(col(column) <= literal_for(df, column, value))


def filter_between(df: DataFrame, column: str, start: Any, end: Any) -> DataFrame:
    """Keep values from start to end, both included."""
    return df.where(col(column).between(literal_for(df, column, start), literal_for(df, column, end)))


def filter_null(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.where(col(column).isNull())


def filter_not_null(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.where(col(column).isNotNull())


def filter_contains(df: DataFrame, column: str, value: str, *, literal: bool = False) -> DataFrame:
    """Keep text that contains the value, case-sensitively.

    `%` and `_` in the value are wildcards unless `literal` is set; a backslash is an ordinary character.
    """
    require(df, column)
    text = col(column).cast("string")
    return df.where(text.contains(value) if literal else text.like("%" + value.replace("\\", "\\\\") + "%"))


def filter_startswith(df: DataFrame, column: str, value: str) -> DataFrame:
    require(df, column)
    return df.where(col(column).cast("string").startswith(value))


def filter_endswith(df: DataFrame, column: str, value: str) -> DataFrame:
    require(df, column)
    return df.where(col(column).cast("string").endswith(value))


def delete_negative(df: DataFrame, column: str) -> DataFrame:
    """Remove negative values, and nulls with them."""
    return filter_greater_equal(df, column, 0)


def delete_zero(df: DataFrame, column: str) -> DataFrame:
    """Remove zeros, and nulls with them."""
    return filter_not_equal(df, column, 0)


def delete_null(df: DataFrame, column: str) -> DataFrame:
    return filter_not_null(df, column)
