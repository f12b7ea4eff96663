"""Calendar expressions and date patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The strftime codes and the datetime pattern letters that mean the same.
STRFTIME_CODES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%j": "DDD",
    "%b": "MMM",
    "%B": "MMMM",
    "%a": "EEE",
    "%A": "EEEE",
    "%F": "yyyy-MM-dd",
    "%T": "HH:mm:ss",
}


def datetime_pattern(pattern: str) -> str:
    """Accept a strftime pattern as well as Spark's own; the latter holds no percent sign."""
    if "%" not in pattern:
        return pattern
    out, literal, i = [], "", 0

    def close() -> str:
        if any(ch.isalpha() for ch in literal) or "'" in literal:
            return "'" + literal.replace("'", "''") + "'"
        return literal

    while i < len(pattern):
        if pattern[i] != "%":
            literal += pattern[i]
            i += 1
            continue
        code = pattern[i : i + 2]
        i += 2
        if code == "%%":
            literal += "%"
            continue
        if code not in STRFTIME_CODES:
            raise ValueError(f"date code {code!r} in {pattern!r} has no counterpart")
        out.append(close())
        literal = ""
        out.append(STRFTIME_CODES[code])
    out.append(close())
    return "".join(out)


def moment(c: Column, kind: T.DataType, pattern: str | None = None) -> Column:
    """A column as a point in time: dates and timestamps as they are, text parsed.

    Text that does not parse becomes null, whatever the session's ANSI setting.
    """
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c
    text = c.cast("string")
    if pattern is None:
        return text.try_cast("timestamp_ntz")
    return F.try_to_timestamp(text, F.lit(datetime_pattern(pattern)))


def working_day(c: Column) -> Column:
    """True from Monday to Friday; a missing date is no working day."""
    return F.coalesce(F.weekday(c) < 5, F.lit(False))


def leap_year(year: Column) -> Column:
    """Gregorian rule on a year number; null stays null."""
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
