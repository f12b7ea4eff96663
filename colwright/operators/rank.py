"""Sorting, the first and last rows per group, and de-duplication."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colwright.columns import as_list, col, fresh_name, require
from colwright.operators.joins import PART_ROWS, broadcast_limit, estimated_bytes, heavy_hashes
from colwright.sources.shared import kept

# Values per group that may be ranked by one task; larger n are ranked by ranges.
WINDOWED = 10_000
# Estimated size of a table that a single task may sort, were all its rows the same.
SORTED_BYTES = 128 << 20
# Copies of a row that are numbered at a time.
SLICE = 1 << 16


def spread_sort(df: DataFrame, *order: Column, split_copies: bool | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Global sort in which a hash of the row is the last key.

    The hash lets the range partitioning cut through a hot value; sorted on the value
    alone, all its rows would share a task. It is deterministic, so filters
    after the sort still reach the scan. Rows that tie come out in the order of their hashes.

    Full copies of one row have one hash, too. Where the table is estimated at more than SORTED_BYTES, two jobs run when called that find
    the rows with more than `part_rows` copies: those are counted, sorted as (row, number of the copy) and so
    dealt over ranges like any other rows. `split_copies=True` looks for them whatever the estimate says, `False` leaves the sort lazy.
    Tables with columns that Spark can't compare (maps, variants) are not searched for copies.
    """
    names = [f.name for f in df.schema.fields if _orderable(f.dataType)]
    tie, copy = fresh_name(df, "__tie"), fresh_name(df, "__copy")
    marked = df.withColumn(tie, F.xxhash64(*map(col, names)) if names else F.lit(0))
    if split_copies is None:
        split_copies = not df.isStreaming and estimated_bytes(df) > SORTED_BYTES
    if split_copies and names and len(names) == len(df.columns):
        hot = _copied_rows(marked, tie, part_rows)
        if not hot.isEmpty():
            cold = marked.join(F.broadcast(hot), tie, "left_anti").withColumn(copy, F.lit(0).cast("bigint"))
            copies = _numbered_copies(marked.join(F.broadcast(hot), tie, "left_semi"), names, tie, copy)
            return cold.unionByName(copies).orderBy(*order, col(tie), col(copy)).select(*map(col, df.columns))
    return marked.orderBy(*order, col(tie)).drop(tie)


def _copied_rows(marked: DataFrame, tie: str, part_rows: int) -> DataFrame:
    """Hashes that more than `part_rows` rows have: candidates from a bounded sketch per task, then exact counts of those alone."""
    listed = kept(heavy_hashes(marked, col(tie), part_rows), "copied-hashes")
    counts = marked.select(col(tie).alias("h")).join(F.broadcast(listed), "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
    return kept(counts.where(F.col("n") > part_rows).select(F.col("h").alias(tie)), "copied-rows")


def _numbered_copies(rows: DataFrame, names: Sequence[str], tie: str, copy: str) -> DataFrame:
    """Each different row as often as it came, with the number of the copy; only (row, count) is shuffled, and slices of the numbers.

    Grouping takes -0.0 and 0.0 for equal, so fractions are grouped by their text as well: rows come out as they went in.
    """
    spark = rows.sparkSession
    texts = [col(f.name).cast("string") for f in rows.schema.fields if re.search("float|double", f.dataType.simpleString())]
    keys = [k.alias(f"k{i}") for i, k in enumerate([col(tie), *map(col, names), *texts])]
    counts = rows.groupBy(*keys).agg(F.max(F.struct(*map(col, names))).alias("row"), F.count("*").alias("n"))
    slices = counts.select(
        F.col("k0").alias("h"), "row", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / SLICE))).alias("slice")
    )
    # The number of partitions is given, as slices look small to Spark before their copies are made.
    dealt = slices.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h", "slice")
    numbers = F.sequence(F.col("slice") * SLICE, F.least((F.col("slice") + 1) * SLICE, F.col("n")) - 1)
    return dealt.select(F.col("h").alias(tie), "row", F.explode(numbers).alias(copy)).select("row.*", tie, copy)


def _orderable(kind: T.DataType) -> bool:
    """Whether Spark can hash and compare the type: maps it can't, wherever they are."""
    return "map<" not in kind.simpleString() and "variant" not in kind.simpleString()


def sort_asc(df: DataFrame, column: str, *, split_copies: bool | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Ascending, nulls first. Full copies of a row are dealt over tasks as `spread_sort` says."""
    require(df, column)
    return spread_sort(df, col(column).asc(), split_copies=split_copies, part_rows=part_rows)


def sort_desc(df: DataFrame, column: str, *, split_copies: bool | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Descending, nulls last."""
    require(df, column)
    return spread_sort(df, col(column).desc(), split_copies=split_copies, part_rows=part_rows)


def pick_first_n(df: DataFrame, column: str, order_column: str, n: int) -> DataFrame:
    """Per value of `column` the rows with the n largest `order_column`, and their `rank`.

    Rows that tie at the edge all stay. Values are ranked, not rows, in a job of its own when called: rows enter only a
    count per group and value. For n up to WINDOWED each task keeps n values of a group before they are ranked together; beyond, the
    counts are dealt by ranges of (group, value), and running sums within a range plus the sums of a group's earlier ranges are the ranks.
    Rows then get their rank by a join, in which the rows of a tie are dealt over tasks in proportion to their number.
    So no task needs a group, or a tie, as a whole, at any n.
    """
    return _pick(df, column, order_column, int(n), True)


def pick_last_n(df: DataFrame, column: str, order_column: str, n: int) -> DataFrame:
    """As `pick_first_n`, with the n smallest values."""
    return _pick(df, column, order_column, int(n), False)


def _pick(df: DataFrame, group: str, value: str, n: int, largest: bool) -> DataFrame:
    require(df, group, value)
    fresh_name(df, "rank")
    order = F.col("v").desc() if largest else F.col("v").asc()
    pairs = df.groupBy(col(group).alias("g"), col(value).alias("v")).agg(F.count("*").alias("n"))
    ranked = _ranked_windows(pairs, order, n) if n <= WINDOWED else _ranked_ranges(pairs, order)
    ranks = kept(ranked.where(F.col("rank") <= n).select("g", "v", "n", F.col("rank").cast("int").alias("rank")), "ranks")
    return _with_ranks(df, group, value, ranks)


def _ranked_windows(pairs: DataFrame, order: Column, n: int) -> DataFrame:
    """The n first values of each group, which hold all ranks up to n; cut per task before the shuffle."""
    inner = Window.partitionBy("g").orderBy(order)
    few = pairs.withColumn("place", F.row_number().over(inner)).where(F.col("place") <= n)
    before = F.sum("n").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    return few.withColumn("rank", F.coalesce(before, F.lit(0)) + 1)


def _ranked_ranges(pairs: DataFrame, order: Column) -> DataFrame:
    dealt = kept(pairs.repartitionByRange(F.col("g"), order).withColumn("part", F.spark_partition_id()), "values")
    before = Window.unboundedPreceding, -1
    inner = Window.partitionBy("g", "part").orderBy(order).rowsBetween(*before)
    # A group has at most one row per range here.
    sums = dealt.groupBy("g", "part").agg(F.sum("n").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("part").rowsBetween(*before)), F.lit(0))
    earlier = sums.select(F.col("g").alias("h"), F.col("part").alias("p"), earlier.alias("earlier"))
    ranked = dealt.withColumn("here", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(
        earlier, F.col("g").eqNullSafe(F.col("h")) & (F.col("part") == F.col("p"))
    )
    return ranked.withColumn("rank", F.col("earlier") + F.col("here") + 1)


def _with_ranks(df: DataFrame, group: str, value: str, ranks: DataFrame) -> DataFrame:
    """The rows that have a rank. Where Spark does not broadcast the ranks, large ties are dealt over several tasks."""
    spark = df.sparkSession
    group_, value_, copies, at, salt, salt_ = (fresh_name(df, f"__{x}") for x in ("group", "value", "copies", "at", "salt", "salt_"))
    named = ranks.select(F.col("g").alias(group_), F.col("v").alias(value_), "rank", "n")
    same = col(group).eqNullSafe(col(group_)) & col(value).eqNullSafe(col(value_))
    if estimated_bytes(ranks) <= broadcast_limit(spark):
        return df.join(named.drop("n"), same).drop(group_, value_)
    # A part is a small share of a task's rows, and of bounded size where tasks are large: there are few such ties.
    total = ranks.agg(F.sum("n")).first()[0] or 0
    share = max(1, min(PART_ROWS, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    named = named.withColumn(copies, F.ceil(F.col("n") / share).cast("int")).drop("n")
    ties = F.broadcast(named.where(col(copies) > 1).drop("rank"))
    rows = df.withColumn(at, F.monotonically_increasing_id()).join(ties, same, "left")
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(col(at)), F.coalesce(col(copies), F.lit(1))).cast("int")).drop(group_, value_, copies, at)
    there = named.withColumn(salt_, F.explode(F.sequence(F.lit(0), col(copies) - 1))).drop(copies)
    return rows.join(there, same & (col(salt) == col(salt_))).drop(group_, value_, salt, salt_)


def deduplicate(df: DataFrame, column: str, *, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """One row per value of the column (null is one value): the first in the order of `order_by`, then of all other columns.

    So the row that stays is the same whenever the table is computed. Groups are reduced before the shuffle.
    """
    require(df, column)
    first = [] if order_by is None else as_list(order_by)
    require(df, *first)
    rest = [f for f in df.schema.fields if f.name not in (column, *first)]
    order = [col(c).asc() for c in first]
    order += [(col(f.name) if _orderable(f.dataType) else F.to_json(col(f.name))).asc() for f in rest]
    place = fresh_name(df, "__place")
    window = Window.partitionBy(col(column)).orderBy(*(order or [col(column)]))
    return df.withColumn(place, F.row_number().over(window)).where(col(place) == 1).drop(place)
