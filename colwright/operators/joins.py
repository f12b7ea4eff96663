"""The join of two tables on equal keys, and the splitting of hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colwright.columns import as_list, col, require
from colwright.sources.shared import kept

HOWS = ("inner", "left", "right", "full", "left_semi", "left_anti")
# Other spellings that Spark knows for the same six joins.
SPELLINGS = {
    "leftouter": "left",
    "rightouter": "right",
    "outer": "full",
    "fullouter": "full",
    "semi": "left_semi",
    "leftsemi": "left_semi",
    "anti": "left_anti",
    "leftanti": "left_anti",
}
# Rows of one key that a task of a join takes; keys with more are dealt over several.
PART_ROWS = 2_000_000
# Joined rows that a key may make in one task, per row of PART_ROWS.
PAIRS_PER_ROW = 100
# Counters of a summary of keys. It is certain to hold every key with more than 7 rows in SUMMARY_MOST.
SUMMARY_LEAST, SUMMARY_MOST = 1024, 1_000_000
# Rows that match nothing are dealt over this many keys.
LOOSE = 1 << 30


def join_tables(
    left: DataFrame,
    right: DataFrame,
    left_on: str | Sequence[str],
    right_on: str | Sequence[str] | None = None,
    how: str = "inner",
    *,
    split_hot_keys: bool | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Equi-join on pairs of key columns; one key column per pair comes out, under the left name.

    Other columns of the right table whose names the left one has get the ending `_right`.

    No task takes more than about `part_rows` rows of one key and side. Where Spark's estimates say that a side can be
    broadcast, or that a table has fewer rows than that, this holds by itself, and the join is Spark's own: lazy, without a job.
    Otherwise two jobs run when called, each of which reads the keys of both tables: mergeable summaries find the keys
    with many rows, and those few are counted exactly. A hot key's rows are dealt over a grid, so many
    parts on each side as its rows need, and each side is repeated over the other's parts. Rows without a match, those with null keys
    among them, are spread. The rows themselves are read and shuffled once per side, as in a plain join.
    `split_hot_keys=True` looks for hot keys whatever the estimates say, `False` leaves all to Spark.
    """
    left_on = as_list(left_on)
    right_on = left_on if right_on is None else as_list(right_on)
    if len(left_on) != len(right_on):
        raise ValueError("both tables need the same number of key columns")
    require(left, *left_on)
    require(right, *right_on)
    how = how.lower()
    how = SPELLINGS.get(how.replace("_", ""), how)
    if how not in HOWS:
        raise ValueError(f"join type {how!r} is none of {HOWS}")
    right = _named_as(right, left_on, right_on)
    right = _apart(left, right, left_on)
    if split_hot_keys is None:
        split_hot_keys = not (_streamed(left, right) or _broadcast(left, right, how) or max(map(estimated_bytes, (left, right))) <= part_rows)
    if split_hot_keys:
        marks = _hot_keys(left, right, left_on, part_rows)
        if not marks.isEmpty():
            return _split_join(left, right, left_on, how, marks)
    return left.join(right, on=left_on, how=how)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of the table's size, which decides its broadcasts too."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def _streamed(*tables: DataFrame) -> bool:
    return any(df.isStreaming for df in tables)


def _broadcast(left: DataFrame, right: DataFrame, how: str) -> bool:
    """Whether Spark would send one table to all tasks, so that the rows of the other stay where they are."""
    limit = broadcast_limit(left.sparkSession)
    if how == "full":
        return False
    sides = [right] if how != "right" else [left]
    return any(estimated_bytes(df) <= limit for df in ([left, right] if how == "inner" else sides))


def _apart(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rename the right columns that clash with left ones."""
    taken = {c.lower() for c in [*left.columns, *right.columns]}
    theirs = {c.lower() for c in left.columns} - {k.lower() for k in keys}
    names = []
    for c in right.columns:
        name = c
        if c.lower() in theirs:
            while name.lower() in taken:
                name += "_right"
            taken.add(name.lower())
        names.append(name)
    return right.toDF(*names)


def _named_as(right: DataFrame, left_on: Sequence[str], right_on: Sequence[str]) -> DataFrame:
    """Give the right key columns the left names."""
    renamed = dict(zip(right_on, left_on))
    taken = [new for old, new in renamed.items() if old != new and new in right.columns and new not in renamed]
    if taken:
        raise ValueError(f"the right table has other columns named like the left keys: {taken}")
    return right.select(*[col(c).alias(renamed.get(c, c)) for c in right.columns])


def heavy_hashes(df: DataFrame, hashed: Column, part_rows: int) -> DataFrame:
    """All values `h` of `hashed` with more than `part_rows` rows and perhaps others: one pass with a bounded sketch per task.

    A sketch of m counters is off by at most 3.5 rows in m. Rows take a byte at least, so the size bounds their number.
    """
    counters = min(SUMMARY_MOST, max(SUMMARY_LEAST, 8 * estimated_bytes(df) // part_rows))
    top = F.expr(f"approx_top_k(h, {counters}, {counters})")
    return df.select(hashed.alias("h")).agg(top.alias("top")).select(F.explode("top").alias("t")).select(F.col("t.item").alias("h"))


def _hash(keys: Sequence[Column]) -> Column:
    return F.when(reduce(lambda a, b: a & b, [k.isNotNull() for k in keys]), F.xxhash64(*keys)).otherwise(F.lit(0))


def _comparable(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[Column]:
    """The keys in the type in which the join compares them, so that equal keys have equal hashes."""
    found = []
    for k in keys:
        kind = left.schema[k].dataType
        if kind != right.schema[k].dataType:
            kind = left.select(col(k)).union(right.select(col(k))).schema[0].dataType
        key = col(k).cast(kind)
        found.append(F.when(key != 0, key).otherwise(F.lit(0).cast(kind)) if isinstance(kind, T.FractionalType) else key)
    return [F.when(col(k).isNotNull(), key) for k, key in zip(keys, found)]


def _hot_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], part_rows: int) -> DataFrame:
    """Keys that need several tasks: their parts on each side, and whether both tables have them. Nulls are one key.

    The tables are kept, so that all branches of the join agree on them. They have no more rows than there are `part_rows` in
    both tables, or counters in two summaries.
    """
    values = _comparable(left, right, keys)
    found = kept(reduce(DataFrame.unionByName, [heavy_hashes(df, _hash(values), part_rows) for df in (left, right)]).distinct(), "hot-hashes")
    counts = []
    for df, (here, other) in ((left, ("l", "r")), (right, ("r", "l"))):
        named = [F.when(_complete(keys), k).alias(f"k{i}") for i, k in enumerate(values)]
        listed = df.select(_hash(values).alias("h"), *named).join(F.broadcast(found), "h", "left_semi")
        counts.append(listed.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count("*").alias(here)).withColumn(other, F.lit(0).cast("bigint")))
    names = [f"k{i}" for i in range(len(keys))]
    both = counts[0].unionByName(counts[1]).groupBy(*names).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / part_rows)).cast("bigint")
    # More parts, in proportion to the rows, where the pairs are more than a task should make.
    more = F.sqrt(F.col("l").cast("double") * F.col("r") / (F.lit(float(PAIRS_PER_ROW * part_rows)) * parts("l") * parts("r")))
    more = F.when((F.col("l") > 0) & (F.col("r") > 0), F.greatest(F.lit(1.0), more)).otherwise(1.0)
    cells = lambda n: F.least(F.greatest(F.col(n), F.lit(1)), F.ceil(parts(n) * more)).cast("int")
    known = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    shared = known & (F.col("l") > 0) & (F.col("r") > 0)
    marks = both.select(*names, cells("l").alias("l"), cells("r").alias("r"), shared.alias("shared"))
    return kept(marks.filter("l > 1 OR r > 1"), "hot-keys")


def _split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, marks: DataFrame) -> DataFrame:
    """One routed pass per side: each row learns its cells, and the join is on the keys and the cells.

    Rows of a shared hot key meet all rows of the other side once, but in some of their cells they may meet none; such
    unmatched copies are dropped, as the key is known to match.
    """
    names = [_unused(f"__key{i}", left, right) for i in range(len(keys))]
    n_l, n_r, shared, at = (_unused(n, left, right) for n in ("__l", "__r", "__shared", "__at"))
    a, b = _unused("__a", left, right), _unused("__b", left, right)
    marks = F.broadcast(marks.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(names)], F.col("l").alias(n_l), F.col("r").alias(n_r), F.col("shared").alias(shared)))

    def marked(df: DataFrame) -> DataFrame:
        # A row with an incomplete key belongs to the key of nulls.
        complete = reduce(lambda x, y: x & y, [df[_quoted(k)].isNotNull() for k in keys])
        same = reduce(lambda x, y: x & y, [F.when(complete, df[_quoted(k)]).eqNullSafe(col(n)) for k, n in zip(keys, names)])
        return df.join(marks, same, "left").drop(*names)

    if how in ("left_semi", "left_anti"):
        # Nothing is multiplied here, and for hot keys the answer is known.
        rows = marked(left)
        hot = rows.where(col(shared) if how == "left_semi" else ~col(shared)).select(*[col(c) for c in left.columns])
        cold = rows.where(col(shared).isNull()).select(*[col(c) for c in left.columns])
        others = marked(right).where(col(shared).isNull()).select(*[col(k) for k in keys])
        return cold.join(others, on=list(keys), how=how).unionByName(hot)

    def routed(df: DataFrame, own: str, copies: str, cell: str, other: str) -> DataFrame:
        # By position, not by content: copies of one row must not end up together either. Hashed, as rows of a key may come at regular distances.
        rows = marked(df).withColumn(at, F.monotonically_increasing_id())
        alone = F.coalesce(~col(shared), F.lit(False))
        mine = F.when(alone, F.pmod(col(at), F.lit(LOOSE))).otherwise(F.pmod(F.xxhash64(col(at)), F.coalesce(col(own), F.lit(1))))
        repeats = F.when(alone, F.lit(1)).otherwise(F.coalesce(col(copies), F.lit(1)))
        rows = rows.withColumn(cell, mine.cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), repeats - 1)))
        return rows.select(*[col(c) for c in df.columns], col(a), col(b), col(shared))

    ours, theirs = routed(left, n_l, n_r, a, b), routed(right, n_r, n_l, b, a)
    in_l, in_r = _unused("__in_l", left, right), _unused("__in_r", left, right)
    ours = ours.withColumnRenamed(shared, in_l)
    theirs = theirs.withColumnRenamed(shared, in_r)
    here, there = _unused("__here", left, right), _unused("__there", left, right)
    joined = ours.withColumn(here, F.lit(True)).join(theirs.withColumn(there, F.lit(True)), on=[*keys, a, b], how=how)
    empty_copy = (col(here).isNull() & F.coalesce(col(in_r), F.lit(False))) | (col(there).isNull() & F.coalesce(col(in_l), F.lit(False)))
    if how != "inner":
        joined = joined.where(~empty_copy)
    return joined.select(*[col(k) for k in keys], *[col(c) for c in [*left.columns, *right.columns] if c not in keys])


def splits_by_rows(counts: DataFrame, rows: str, name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Of keys with their exact number of rows those that need several tasks, and into how many: `name`."""
    hot = counts.where(F.col(rows) > part_rows)
    return hot.withColumn(name, F.ceil(F.col(rows) / part_rows).cast("int")).drop(rows)


def join_to_unique(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, splits: str) -> DataFrame:
    """Left join to a table with one row per key; left rows of the `hot` keys go to `splits` tasks each, and those of nulls to many."""
    at, salt = _unused("__at", left, right), _unused("__salt", left, right)
    marks = F.broadcast(hot)
    dealt = F.when(col(key).isNull(), F.pmod(col(at), F.lit(LOOSE))).otherwise(F.pmod(F.xxhash64(col(at)), F.coalesce(splits, F.lit(1)))).cast("int")
    here = left.withColumn(at, F.monotonically_increasing_id()).join(marks, key, "left").withColumn(salt, dealt).drop(at, splits)
    copies = F.sequence(F.lit(0), F.coalesce(splits, F.lit(1)) - 1)
    there = right.join(marks, key, "left").withColumn(salt, F.explode(copies)).drop(splits)
    return here.join(there, on=[key, salt], how="left").drop(salt)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _unused(name: str, *tables: DataFrame) -> str:
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _complete(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [col(k).isNotNull() for k in keys])
