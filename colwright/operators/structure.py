"""Operators that change the columns of a table: drop, rename, cast, concatenate, split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colwright.columns import add_column, as_list, col, fresh_name, move_after, require, type_of

# All text that casts to an integer looks like this; blanks and control characters around it are ignored.
WHOLE_NUMBER = r"^[\s\p{Cntrl}]*[+-]?[0-9]+[\s\p{Cntrl}]*$"


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return drop_columns(df, [column])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    columns = as_list(columns)
    require(df, *columns)
    return df.drop(*columns)


def rename_column(df: DataFrame, column: str, new_column: str) -> DataFrame:
    require(df, column)
    return df.withColumnRenamed(column, fresh_name(df.drop(column), new_column))


def to_string(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.withColumn(column, col(column).cast("string"))


def to_integer(df: DataFrame, column: str) -> DataFrame:
    """Cast to a 32-bit integer: fractions are cut off, what does not fit or read as one becomes null."""
    value, kind = col(column), type_of(df, column)
    # try_cast pays for an exception per bad value; the conditions let it see few of them.
    if isinstance(kind, T.StringType):
        value = F.when(value.rlike(WHOLE_NUMBER), value)
    elif isinstance(kind, (T.LongType, T.FractionalType)):
        value = F.when((value > -(2**31) - 1) & (value < 2**31), value)
    return df.withColumn(column, value.try_cast("int"))


def concat_columns(
    df: DataFrame, columns: Sequence[str], new_column: str, *, after: str | None = None
) -> DataFrame:
    return merge_columns(df, columns, new_column, "", after=after)


def merge_columns(
    df: DataFrame, columns: Sequence[str], new_column: str, separator: str, *, after: str | None = None
) -> DataFrame:
    """All columns as text with a separator between them; null if any of them is null."""
    columns = as_list(columns)
    require(df, *columns)
    parts = [col(columns[0]).cast("string")]
    for c in columns[1:]:
        if separator:
            parts.append(F.lit(separator))
        parts.append(col(c).cast("string"))
    return add_column(df, new_column, F.concat(*parts), after)


def max_split_size(df: DataFrame, column: str, delimiter: str) -> DataFrame:
    """Largest number of pieces that splitting the column gives, as a one-row table."""
    require(df, column)
    pieces = F.size(F.split(col(column).cast("string"), delimiter))
    return df.where(col(column).isNotNull()).agg(F.max(pieces).alias("max_size"))


def split_column(
    df: DataFrame,
    column: str,
    delimiter: str,
    *,
    n: int | None = None,
    prefix: str = "column_",
    after_source: bool = False,
) -> DataFrame:
    """Split on a regular expression into `prefix0`, `prefix1`, ...; missing pieces are null.

    The number of new columns is the largest piece count in the table. It decides
    the schema, so without `n` one aggregation job runs here; with `n` (the
    number of columns wanted) nothing runs, and a row with more pieces is an error.
    """
    require(df, column)
    pieces = F.split(col(column).cast("string"), delimiter)
    if n is None:
        n = max_split_size(df, column, delimiter).first().max_size or 0
    else:
        excess = F.concat(F.lit(f"column {column} splits into more than {n} pieces: "), col(column).cast("string"))
        pieces = F.when(F.size(pieces) > n, F.raise_error(excess)).otherwise(pieces)
    names = [fresh_name(df, f"{prefix}{i}") for i in range(n)]
    # One projection for all pieces, and one split per row: the array is a column of its own below it.
    held = fresh_name(df, "__pieces")
    out = df.withColumn(held, pieces).select(
        *[col(c) for c in df.columns], *[F.get(col(held), F.lit(i)).alias(name) for i, name in enumerate(names)]
    )
    return move_after(out, names, column) if after_source and names else out
