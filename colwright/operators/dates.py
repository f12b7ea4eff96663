"""Date and time operators.

Text columns are accepted too: text that does not parse counts as null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colwright.columns import add_column, col, type_of
from colwright.functions.calendar import datetime_pattern, leap_year, moment, working_day
from colwright.operators.rank import spread_sort


def _moment(df: DataFrame, column: str, pattern: str | None = None) -> Column:
    return moment(col(column), type_of(df, column), pattern)


def _extract(
    df: DataFrame, column: str, new_column: str, part: Callable[[Column], Column], after: str | None
) -> DataFrame:
    return add_column(df, new_column, part(_moment(df, column)), after)


def extract_year(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    return _extract(df, column, new_column, F.year, after)


def extract_month(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    return _extract(df, column, new_column, F.month, after)


def extract_day(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    """Day of the month."""
    return _extract(df, column, new_column, F.dayofmonth, after)


def extract_hour(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    return _extract(df, column, new_column, F.hour, after)


def extract_minute(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    return _extract(df, column, new_column, F.minute, after)


def extract_second(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    return _extract(df, column, new_column, F.second, after)


def extract_day_of_week(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    """1 for Sunday to 7 for Saturday."""
    return _extract(df, column, new_column, F.dayofweek, after)


def is_weekday(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    """True from Monday to Friday; false at weekends and where there is no date."""
    return _extract(df, column, new_column, working_day, after)


def is_leap_year(df: DataFrame, column: str, new_column: str, *, after: str | None = None) -> DataFrame:
    """Whether the year number in an integer column is a leap year."""
    type_of(df, column)
    return add_column(df, new_column, leap_year(col(column).try_cast("bigint")), after)


def date_diff(
    df: DataFrame, column: str, other: str, new_column: str, *, after: str | None = None
) -> DataFrame:
    """Whole calendar days from `other` to `column`."""
    days = F.datediff(_moment(df, column), _moment(df, other))
    return add_column(df, new_column, days, after)


def parse_date(df: DataFrame, column: str, pattern: str | None = None) -> DataFrame:
    """Turn a text column into a date column, in place."""
    return df.withColumn(column, _moment(df, column, pattern).cast("date"))


def change_date_format(df: DataFrame, column: str, pattern: str, *, read_as: str | None = None) -> DataFrame:
    """Render a date, timestamp or text column in a given format, in place.

    Both patterns may use Spark's letters or strftime codes. Text is read with
    `read_as`, or as ISO text without it.
    """
    rendered = F.date_format(_moment(df, column, read_as), datetime_pattern(pattern))
    return df.withColumn(column, rendered)


def sort_by_date(df: DataFrame, column: str, pattern: str, *, read_as: str | None = None) -> DataFrame:
    """Sort by the date a column stands for, missing ones last, and render it with `pattern`."""
    when = _moment(df, column, read_as)
    return change_date_format(spread_sort(df, when.asc_nulls_last()), column, pattern, read_as=read_as)
