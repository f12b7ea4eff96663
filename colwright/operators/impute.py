"""Replacement of nulls, negatives and zeros by constants, means and medians.

Only the matching rows change. A constant must fit the column's type. A mean or
median makes a column of small integers a double column, which holds them all. A bigint
column becomes decimal(25,6), so that its own values keep all digits; a decimal column keeps
its type, and the mean or median is rounded to its scale. The approximate median
of either is still computed in double.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colwright.columns import add_column, col, is_numeric, literal_like, require, type_of
from colwright.plans.fits import Fit, Params, fitted, present, quantiles, value as param
from colwright.plans.quantiles import exact_type


def _is_null(column: str) -> Column:
    return col(column).isNull()


def _is_negative(column: str) -> Column:
    return col(column) < 0


def _is_zero(column: str) -> Column:
    return col(column) == 0


def _replace(df: DataFrame, column: str, hit: Column, by: Column) -> DataFrame:
    return df.withColumn(column, F.when(hit, by).otherwise(col(column)))


def _need_number(df: DataFrame, column: str) -> None:
    require(df, column)
    if not is_numeric(df, column):
        raise ValueError(f"column {column!r} is not numeric")


def replace_null_const(df: DataFrame, column: str, value: Any) -> DataFrame:
    return _replace(df, column, _is_null(column), literal_like(df, column, value))


def replace_negative_const(df: DataFrame, column: str, value: Any) -> DataFrame:
    _need_number(df, column)
    return _replace(df, column, _is_negative(column), literal_like(df, column, value))


def replace_zero_const(df: DataFrame, column: str, value: Any) -> DataFrame:
    _need_number(df, column)
    return _replace(df, column, _is_zero(column), literal_like(df, column, value))


def fit_mean(df: DataFrame, column: str) -> Fit:
    """Mean over all values but null and NaN, the ones to be replaced included."""
    _need_number(df, column)
    exact = exact_type(type_of(df, column))
    if exact:
        return {"mean": F.try_avg(col(column).cast(exact)).cast("string")}
    return {"mean": F.avg(present(col(column)))}


def fit_median(df: DataFrame, column: str, approx: bool = False) -> Fit:
    _need_number(df, column)
    return {"median": quantiles(col(column), [0.5], interpolate=True, approx=approx)}


def _filled_type(df: DataFrame, column: str) -> T.DataType:
    kind = type_of(df, column)
    if isinstance(kind, T.LongType):
        return T.DecimalType(25, 6)
    return kind if isinstance(kind, T.DecimalType) else T.DoubleType()


def _fill(df: DataFrame, column: str, hit: Column, by: Any) -> DataFrame:
    kind = _filled_type(df, column)
    return df.withColumn(column, F.when(hit, param(by, kind)).otherwise(col(column).cast(kind)))


def _by_mean(df: DataFrame, column: str, hit: Column, params: Params | None) -> DataFrame:
    return _fill(df, column, hit, fitted(df, fit_mean(df, column), params)["mean"])


def _by_median(df: DataFrame, column: str, hit: Column, approx: bool, params: Params | None) -> DataFrame:
    return _fill(df, column, hit, fitted(df, fit_median(df, column, approx), params)["median"][0])


def replace_null_mean(df: DataFrame, column: str, *, params: Params | None = None) -> DataFrame:
    return _by_mean(df, column, _is_null(column), params)


def replace_negative_mean(df: DataFrame, column: str, *, params: Params | None = None) -> DataFrame:
    return _by_mean(df, column, _is_negative(column), params)


def replace_zero_mean(df: DataFrame, column: str, *, params: Params | None = None) -> DataFrame:
    return _by_mean(df, column, _is_zero(column), params)


def replace_null_median(
    df: DataFrame, column: str, *, approx: bool = False, params: Params | None = None
) -> DataFrame:
    return _by_median(df, column, _is_null(column), approx, params)


def replace_negative_median(
    df: DataFrame, column: str, *, approx: bool = False, params: Params | None = None
) -> DataFrame:
    return _by_median(df, column, _is_negative(column), approx, params)


def replace_zero_median(
    df: DataFrame, column: str, *, approx: bool = False, params: Params | None = None
) -> DataFrame:
    return _by_median(df, column, _is_zero(column), approx, params)


def replace_value(
    df: DataFrame, column: str, search: Any, replacement: Any, new_column: str, *, after: str | None = None
) -> DataFrame:
    """New column in which one value (or null, written None or "null") is replaced."""
    require(df, column)
    by = literal_like(df, column, replacement)
    if search is None or search == "null":
        return add_column(df, new_column, F.coalesce(col(column), by), after)
    hit = col(column) == literal_like(df, column, search)
    return add_column(df, new_column, F.when(hit, by).otherwise(col(column)), after)
