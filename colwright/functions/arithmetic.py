"""Arithmetic over several columns and the rounded functions of one column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(step: Callable[[Column, Column], Column], columns: Sequence[Column]) -> Column:
    """Combine columns from left to right; a null in any of them makes the result null."""
    return reduce(step, columns)


def log4(c: Column) -> Column:
    """Natural logarithm to four digits; null for zero and below."""
    return F.round(F.ln(c), 4)


def sqrt4(c: Column) -> Column:
    """Square root to four digits; NaN for negatives."""
    return F.round(F.sqrt(c), 4)


def square(c: Column) -> Column:
    x = c.cast("double")
    return x * x
