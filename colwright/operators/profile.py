"""Statistics of columns and tables. Each is one aggregation over one scan; a profile takes a second one for few columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colwright.columns import as_list, col, require, type_of


def _kind(kind: T.DataType) -> str:
    return "integer" if isinstance(kind, T.NumericType) else "string"


# Relative standard error of the sketches, and how many of them a count must be away from the threshold to be believed:
# beyond twelve an error is less likely than one of the digests that texts are compared by (below 1e-30).
SKETCH_ERROR = 0.0085
SURE, NEARLY_SURE = 12, 4


def _plain(df: DataFrame, column: str) -> Column:
    """The column as a bigint, double or text that is equal exactly where the column is."""
    c, kind = col(column), type_of(df, column)
    if isinstance(kind, T.IntegralType):
        return c.cast("bigint")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.BinaryType):
        c = F.hex(c)
    text = F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
    return F.sha2(text, 256)  # so that no long text is shuffled


def _sketched(df: DataFrame, column: str) -> Column:
    """The column for a sketch, which hashes texts itself."""
    kind = type_of(df, column)
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return col(column).cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (col(column).cast("double") + F.lit(0.0)).cast("string")
    return _plain(df, column)


def _about_distinct(df: DataFrame) -> DataFrame:
    """Rows, and distinct values per column within about one percent, from sketches of a few kilobytes."""
    sketches = [F.hll_sketch_agg(_sketched(df, c), 14) for c in df.columns]
    return df.agg(
        F.count("*").alias("rows"), *[F.hll_sketch_estimate(s).alias(f"d{i}") for i, s in enumerate(sketches)]
    )


def _told_apart(df: DataFrame, sure: float) -> DataFrame:
    """As `_about_distinct`, with exact counts of the columns that are within `sure` standard errors of a tenth of the rows."""
    about = _about_distinct(df).first()
    limit = about["rows"] / 10
    close = [i for i in range(len(df.columns)) if abs(about[f"d{i}"] - limit) <= sure * SKETCH_ERROR * max(limit, about[f"d{i}"])]
    known = about.asDict()
    if close and about["rows"]:
        exact = _distinct(df.select(*[col(df.columns[i]) for i in close])).first()
        known.update({f"d{i}": exact[f"d{k}"] for k, i in enumerate(close)})
    return df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in known.items()])


def _distinct(df: DataFrame) -> DataFrame:
    """Rows, and distinct non-null values per column, in one scan.

    Each row becomes one narrow cell per column, and equal cells are combined before
    the shuffle. Several count_distinct in one aggregation would instead shuffle
    cells as wide as the whole table.
    """
    plain = df.select(*[_plain(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    kinds = {"bigint": "whole", "double": "broken", "string": "text"}
    cells = []
    for i, f in enumerate(plain.schema.fields):
        slot = kinds[f.dataType.simpleString()]
        values = [(F.col(f.name) if name == slot else F.lit(None)).cast(kind).alias(name) for kind, name in kinds.items()]
        cells.append(F.struct(F.lit(i).alias("i"), *values))
    value = F.col("whole").isNotNull() | F.col("broken").isNotNull() | F.col("text").isNotNull()
    combined = plain.select(F.inline(F.array(*cells))).groupBy("i", "whole", "broken", "text").agg(F.count("*").alias("n"))
    return combined.agg(
        F.coalesce(F.sum(F.when(F.col("i") == 0, F.col("n"))), F.lit(0)).alias("rows"),
        *[F.count_if((F.col("i") == i) & value).alias(f"d{i}") for i in range(len(cells))],
    )


def column_profile(df: DataFrame, *, approx: bool = False) -> DataFrame:
    """One row per column: `column_name`, `ftype`, `type` and position `rank`.

    `ftype` is `classification` when at most a tenth as many distinct values as
    rows occur, else `continuous`. It runs when called: one scan fills a sketch per column, which decides all columns that
    are far from the threshold; those within twelve standard errors (a tenth) of it are counted exactly, and no other
    column is shuffled. `approx` counts only those within four standard errors.
    """
    counts = _told_apart(df, NEARLY_SURE if approx else SURE)
    few = lambda i: F.col(f"d{i}") <= F.col("rows") / 10
    lines = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.when(few(i), "classification").otherwise("continuous").alias("ftype"),
            F.lit(_kind(df.schema[c].dataType)).alias("type"),
            F.lit(i).alias("rank"),
        )
        for i, c in enumerate(df.columns)
    ]
    return counts.select(F.inline(F.array(*lines)))


def _whole(df: DataFrame, column: str, c: Column) -> Column:
    """Cut off the fraction. Whole numbers and decimals never go through a double."""
    kind = type_of(df, column)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"column {column!r} holds dates or times, which are no numbers")
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        return c.try_cast("bigint")
    return c.try_cast("double").try_cast("bigint")


def column_min_max(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest value as whole numbers, fractions cut off."""
    require(df, column)
    return df.agg(_whole(df, column, F.min(col(column))).alias("min"), _whole(df, column, F.max(col(column))).alias("max"))


def column_mean(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.agg(F.avg(col(column).try_cast("double")).alias("mean"))


def column_describe(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum, one row per column."""
    columns = as_list(columns)
    require(df, *columns)
    lines = []
    for c in columns:
        if not isinstance(type_of(df, c), T.NumericType):
            raise ValueError(f"column {c!r} is not numeric")
        x = col(c).cast("double")
        lines.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(x).alias("count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("stddev"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
            )
        )
    return df.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.select(col(column)).distinct()


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct values, null counting as one."""
    return distinct_values(df, column).agg(F.count("*").alias("distinct_count"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def column_count(df: DataFrame) -> int:
    return len(df.columns)


def table_size(df: DataFrame) -> DataFrame:
    """Rows and columns of the table."""
    return df.agg(F.count("*").alias("rows"), F.lit(column_count(df)).alias("columns"))


def column_metadata(df: DataFrame) -> DataFrame:
    """One row per column: `index`, `label` and `type`, read off the schema without a job.

    All numeric types show as `integer`, every other type under its own name.
    """
    rows = [
        (i, f.name, "integer" if isinstance(f.dataType, T.NumericType) else f.dataType.simpleString())
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, "index int, label string, type string")
