"""Running numbers within groups, however large a group is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colwright.columns import col
from colwright.llm.text import free_name
from colwright.sources.shared import kept

ROW_BITS = 33  # Spark's running ids hold the partition above these bits, the row within it below


def numbered(df: DataFrame, group: str, order: Sequence[Column], name: str) -> DataFrame:
    """Append `pos`, from 0 in the given order within each group, and `n`, the group's rows; both bigint.

    Rows are dealt by ranges of (group, order), so a group with most of the rows is spread over many
    tasks; the numbers of a range start behind the sums of the group's earlier ranges. The table is kept, so
    the numbers stay whatever is computed again. The group must not be null. Rows that tie in
    the whole order are numbered in any order; an empty table stays empty. Columns named pos or n are replaced.
    """
    df = df.select(*[col(c) for c in df.columns if c.lower() not in ("pos", "n")])
    at, part, idx, low = (free_name(df, f"__{x}") for x in ("at", "part", "idx", "low"))
    # The last key only spreads rows that are equal in all others.
    spread = df.withColumn(at, F.monotonically_increasing_id())
    keys = [col(group), *order, col(at)]
    dealt = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(at).withColumn(at, F.monotonically_increasing_id())
    marked = kept(
        dealt.withColumn(part, F.shiftright(col(at), ROW_BITS)).withColumn(idx, col(at).bitwiseAND(F.lit((1 << ROW_BITS) - 1))).drop(at),
        name,
    )
    # One row per range and group: as many as ranges and groups together.
    sums = marked.groupBy(col(group), col(part)).agg(F.count("*").alias("rows"), F.min(col(idx)).alias(low))
    whole = Window.partitionBy(col(group))
    earlier = whole.orderBy(col(part)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        col(group), col(part), (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - col(low)).alias(low), F.sum("rows").over(whole).alias("n")
    )
    own = [col(c) for c in df.columns]
    return marked.join(offsets, [group, part]).select(*own, (col(idx) + col(low)).alias("pos"), F.col("n"))
