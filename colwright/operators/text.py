"""Text operators, in place or into a new column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colwright.columns import add_column, col, require


def _in_place(df: DataFrame, column: str, result: Column) -> DataFrame:
    require(df, column)
    return df.withColumn(column, result)


def _into_new(df: DataFrame, column: str, new_column: str, result: Column, after: str | None) -> DataFrame:
    require(df, column)
    return add_column(df, new_column, result, after)


def upper(df: DataFrame, column: str) -> DataFrame:
    return _in_place(df, column, F.upper(col(column)))


def upper_new(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    return _into_new(df, column, new_column, F.upper(col(column)), after)


def lower(df: DataFrame, column: str) -> DataFrame:
    return _in_place(df, column, F.lower(col(column)))


def lower_new(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    return _into_new(df, column, new_column, F.lower(col(column)), after)


def initcap(df: DataFrame, column: str, new_column: str | None = None, *, after: str | None = None) -> DataFrame:
    """First letter of each blank-separated word upper case, the rest lower case."""
    result = F.initcap(col(column))
    if new_column is None:
        return _in_place(df, column, result)
    return _into_new(df, column, new_column, result, after)


def trim(df: DataFrame, column: str) -> DataFrame:
    """Remove blanks at both ends."""
    return _in_place(df, column, F.trim(col(column)))


def substring_new(
    df: DataFrame, column: str, start: int, length: int, new_column: str, *, after: str | None = None
) -> DataFrame:
    """`length` characters from the 1-based position `start`."""
    piece = F.substring(col(column), int(start), int(length))
    return _into_new(df, column, new_column, piece, after)


def replace_text(df: DataFrame, column: str, search: str, replacement: str) -> DataFrame:
    """Replace every match of a regular expression."""
    return _in_place(df, column, F.regexp_replace(col(column), F.lit(search), F.lit(replacement)))


def replace_text_new(
    df: DataFrame, column: str, search: str, replacement: str, new_column: str, *, after: str | None = None
) -> DataFrame:
    replaced = F.regexp_replace(col(column), F.lit(search), F.lit(replacement))
    return _into_new(df, column, new_column, replaced, after)
