"""Words and names shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colwright.columns import col

# White space as the contracts define it, as a pattern and as characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def whole(name: str) -> Column:
    """The column's text; null counts as empty."""
    return F.coalesce(col(name), F.lit(""))


def words(text: Column) -> Column:
    """The runs of characters that are not white space; an empty array if there are none."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is mentioned and wherever the optimizer moves it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The running sums of an array of numbers, or other running results, by doubling distances: n log n for n values."""

    def doubled(values: Column) -> Column:
        distances = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(values))
        return F.aggregate(
            distances, values, lambda a, d: F.transform(a, lambda x, i: F.when(i >= d, combine(x, F.get(a, i - d))).otherwise(x))
        )

    return let(values, doubled)


def free_name(df: DataFrame, name: str) -> str:
    """A helper column's name that no column of the table has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def place(path: str):
    """The file system of a path as Spark gives it, and the path within it."""
    from pyarrow import fs

    if path.startswith("file:") or path.startswith("/"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)
