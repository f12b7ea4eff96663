"""Column names, guards and literals shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """Column by its literal name, so that names with dots (common in CSV headers) work."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, *names: str) -> None:
    """Raise early when a column is missing; Spark's drop and rename would ignore it."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {missing}; the table has {df.columns}")


def fresh_name(df: DataFrame, name: str) -> str:
    """Normalise a new column name (blanks become underscores) and refuse a taken one."""
    name = name.replace(" ", "_")
    if not name:
        raise ValueError("a new column needs a name")
    # Spark resolves names without regard to case, so `A` would overwrite `a`.
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {name!r} exists already")
    return name


def as_list(names: str | Iterable[str]) -> list[str]:
    names = [names] if isinstance(names, str) else list(names)
    if not names:
        raise ValueError("at least one column is needed")
    return names


def move_after(df: DataFrame, names: Sequence[str], source: str) -> DataFrame:
    """Reorder the table so that `names` stand right behind `source`."""
    require(df, source, *names)
    order: list[str] = []
    for c in df.columns:
        if c not in names:
            order.append(c)
        if c == source:
            order.extend(names)
    return df.select(*[col(c) for c in order])


def add_column(df: DataFrame, name: str, value: Column, after: str | None = None) -> DataFrame:
    """Append a guarded new column, or insert it behind the column `after`."""
    name = fresh_name(df, name)
    df = df.withColumn(name, value)
    return df if after is None else move_after(df, [name], after)


def type_of(df: DataFrame, name: str) -> T.DataType:
    require(df, name)
    return df.schema[name].dataType


def _decimal(value: Any, name: str) -> Decimal:
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        raise ValueError(f"{value!r} is not a number, but column {name!r} is numeric") from None
    return number


def _moment(value: Any, name: str) -> datetime:
    try:
        return datetime.fromisoformat(str(value).strip())
    except ValueError:
        raise ValueError(f"{value!r} is not an ISO date or time for column {name!r}") from None


def literal_like(df: DataFrame, name: str, value: Any) -> Column:
    """`value` as a literal of exactly the column's type, for writing into the column."""
    kind = type_of(df, name)
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.IntegralType):
        number = _decimal(value, name)
        bits = {"byte": 8, "short": 16, "integer": 32, "long": 64}[kind.typeName()]
        if number != number.to_integral_value() or not -(2 ** (bits - 1)) <= number < 2 ** (bits - 1):
            raise ValueError(f"{value!r} does not fit column {name!r} of type {kind.simpleString()}")
        return F.lit(int(number)).cast(kind)
    if isinstance(kind, T.DecimalType):
        number = _decimal(value, name)
        if not number.is_finite() or number != round(number, kind.scale) or abs(number) >= Decimal(10) ** (kind.precision - kind.scale):
            raise ValueError(f"{value!r} does not fit column {name!r} of type {kind.simpleString()}")
        return F.lit(number).cast(kind)
    if isinstance(kind, T.FractionalType):
        return F.lit(float(_decimal(value, name))).cast(kind)
    return literal_for(df, name, value)


def literal_for(df: DataFrame, name: str, value: Any) -> Column:
    """`value` as a literal to compare the column with.

    The literal takes the column's type, so the comparison needs no cast on the
    column and reaches the parquet reader. A number that the type cannot hold
    (2.5 against an int column) keeps its own type instead of being rounded.
    """
    kind = type_of(df, name)
    if isinstance(kind, T.IntegralType):
        number = _decimal(value, name)
        if not number.is_finite() or number != number.to_integral_value():
            return F.lit(float(number))
        return F.lit(int(number)) if abs(number) < 2**63 else F.lit(number)
    if isinstance(kind, T.DecimalType):
        return F.lit(_decimal(value, name))
    if isinstance(kind, T.FractionalType):
        return F.lit(float(_decimal(value, name))).cast(kind)
    if isinstance(kind, T.BooleanType):
        text = str(value).strip().lower()
        if text not in ("true", "false"):
            raise ValueError(f"{value!r} is not true or false, but column {name!r} is boolean")
        return F.lit(text == "true")
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return F.lit(str(value))
    if isinstance(kind, T.DateType):
        moment = _moment(value, name)
        if moment != datetime(moment.year, moment.month, moment.day):
            return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
        return F.lit(moment.date())
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.lit(_moment(value, name).isoformat(sep=" ")).cast(kind)
    return F.lit(value).cast(kind)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), T.NumericType)
