"""Scaling of numeric columns into a new column, rounded to four digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colwright.columns import add_column, col, fresh_name, is_numeric
from colwright.plans.fits import Fit, Params, fitted, present, quantiles, value


def _number(df: DataFrame, column: str) -> Column:
    if not is_numeric(df, column):
        raise ValueError(f"column {column!r} is not numeric")
    return col(column).cast("double")


def _with_value(df: DataFrame, column: str) -> DataFrame:
    """The rows that have a value; only columns that can hold NaN are asked for it."""
    rows = df.where(col(column).isNotNull())
    fractional = rows.select(col(column)).schema[0].dataType.typeName() in ("float", "double")
    return rows.where(~F.isnan(col(column))) if fractional else rows


def fit_standard(df: DataFrame, column: str) -> Fit:
    return {"sd": F.stddev_samp(present(_number(df, column)))}


def scale_standard(
    df: DataFrame, column: str, new_column: str, *, after: str | None = None, params: Params | None = None
) -> DataFrame:
    """Value by sample standard deviation, not centred; rows without a value (null, NaN) are dropped.

    Without any spread (a constant column, or a single row) the result is 0.
    """
    fresh_name(df, new_column)
    x = _number(df, column)
    sd = value(fitted(df, fit_standard(df, column), params)["sd"])
    scaled = F.coalesce(F.round(F.try_divide(x, sd), 4), F.lit(0.0))
    return add_column(_with_value(df, column), new_column, scaled, after)


def fit_minmax(df: DataFrame, column: str) -> Fit:
    x = present(_number(df, column))
    return {"lo": F.min(x), "range": F.max(x) - F.min(x)}


def scale_minmax(
    df: DataFrame, column: str, new_column: str, *, after: str | None = None, params: Params | None = None
) -> DataFrame:
    """Stretch to 0..1; rows without a value (null, NaN) are dropped. A constant column becomes 0.5."""
    fresh_name(df, new_column)
    x = _number(df, column)
    found = fitted(df, fit_minmax(df, column), params)
    lo, range_ = value(found["lo"]), value(found["range"])
    scaled = F.coalesce(F.round(F.try_divide(x - lo, range_), 4), F.lit(0.5))
    return add_column(_with_value(df, column), new_column, scaled, after)


def _null_as_zero(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.nanvl(_number(df, column), F.lit(0.0)), F.lit(0.0))


def fit_robust(df: DataFrame, column: str, approx: bool = False) -> Fit:
    values = _null_as_zero(df, column)
    return {"quartiles": quantiles(values, [0.25, 0.5, 0.75], interpolate=True, approx=approx)}


def scale_robust(
    df: DataFrame,
    column: str,
    new_column: str,
    *,
    approx: bool = False,
    after: str | None = None,
    params: Params | None = None,
) -> DataFrame:
    """Distance from the median by the interquartile range, missing values counting as 0.

    A range of 0 divides by 1 instead.
    """
    fresh_name(df, new_column)
    quartiles = fitted(df, fit_robust(df, column, approx), params)["quartiles"]
    q1, median, q3 = (value(quartiles[i]) for i in range(3))
    distance = _null_as_zero(df, column) - median
    scaled = F.round(F.coalesce(F.try_divide(distance, q3 - q1), distance), 4)
    return add_column(df, new_column, scaled, after)
