"""Arithmetic and mathematical operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colwright.columns import add_column, as_list, col, is_numeric, require, type_of
from colwright.functions.arithmetic import fold, log4, sqrt4, square


def _combine(
    df: DataFrame,
    columns: Sequence[str],
    new_column: str,
    step: Callable[[Column, Column], Column],
    after: str | None,
) -> DataFrame:
    columns = as_list(columns)
    require(df, *columns)
    return add_column(df, new_column, fold(step, [col(c) for c in columns]), after)


# The try_ forms give null where plain operators would fail the job: on integer
# overflow and on division by zero. On doubles they compute the same.


def sum_columns(df: DataFrame, columns: Sequence[str], new_column: str, *, after: str | None = None) -> DataFrame:
    return _combine(df, columns, new_column, F.try_add, after)


def sub_columns(df: DataFrame, columns: Sequence[str], new_column: str, *, after: str | None = None) -> DataFrame:
    """The first column minus all others."""
    return _combine(df, columns, new_column, F.try_subtract, after)


def mul_columns(df: DataFrame, columns: Sequence[str], new_column: str, *, after: str | None = None) -> DataFrame:
    return _combine(df, columns, new_column, F.try_multiply, after)


def div_columns(df: DataFrame, columns: Sequence[str], new_column: str, *, after: str | None = None) -> DataFrame:
    """The first column divided by all others in turn; null on division by zero."""
    return _combine(df, columns, new_column, F.try_divide, after)


def _derive(df: DataFrame, column: str, new_column: str, result: Column, after: str | None) -> DataFrame:
    require(df, column)
    return add_column(df, new_column, result, after)


def log_new(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    """Natural logarithm, four digits; null for zero and below."""
    return _derive(df, column, new_column, log4(col(column)), after)


# The same computation under the name it has among the scalers.
scale_log = log_new


def round_column(df: DataFrame, column: str, digits: int) -> DataFrame:
    """Round in place, halves away from zero."""
    require(df, column)
    return df.withColumn(column, F.round(col(column), int(digits)))


def sqrt_new(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    """Square root, four digits; NaN for negatives."""
    return _derive(df, column, new_column, sqrt4(col(column).try_cast("double")), after)


def square_new(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    return _derive(df, column, new_column, square(col(column)), after)


def _rounded(df: DataFrame, column: str, how: Callable[[Column], Column]) -> Column:
    """The function of the column, null where a double is no bigint or the text no number."""
    if isinstance(type_of(df, column), (T.IntegralType, T.DecimalType)):
        return how(col(column))
    x = col(column).try_cast("double")
    return F.when((x >= -(2.0**63)) & (x < 2.0**63), how(x))


def ceil_new(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    """Smallest whole number not below the value; null for text, NaN and what no bigint holds."""
    return _derive(df, column, new_column, _rounded(df, column, F.ceil), after)


def floor_new(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    """Largest whole number not above the value; null for text, NaN and what no bigint holds."""
    return _derive(df, column, new_column, _rounded(df, column, F.floor), after)


def abs_new(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    """Magnitude; null where the type does not hold it, and for text."""
    c = col(column)
    if not is_numeric(df, column):
        c = c.try_cast("double")
    elif isinstance(type_of(df, column), T.IntegralType):
        lowest = -(2 ** (8 * {"byte": 1, "short": 2, "integer": 4, "long": 8}[type_of(df, column).typeName()] - 1))
        c = F.when(c != lowest, c)
    return _derive(df, column, new_column, F.abs(c), after)
