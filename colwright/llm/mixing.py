"""Mixing sources to target weights by pivotal dependent rounding.

A source gets a target number of words, each of its rows the same expected number of copies. The
whole copies are certain; the rest is a fraction. Pivotal rounding takes two rows with fractions and moves
words from one to the other, at random but fair, until one of them is whole. It keeps the words of the
pair, so a source ends within one row's words of its target, and each row keeps its expectation.

Rows are dealt by a hash of their values into buckets of their source, so a source with most of the rows is
spread over many tasks. Each bucket is rounded as a stream with one open row; what is left of it goes up a
tree, FAN_IN buckets to one, until a single row per source is left, and that one is rounded alone.

Texts without words (null, empty) get the whole copies alone. A null source is a source of its own. Reruns
agree, however the rows are dealt: order, buckets and chance come from a hash of all columns of a row, whatever
of them comes along. Rows alike in all columns are interchangeable, so which of them is taken is open; if
they are more than a bucket's, they are numbered and dealt over buckets by their numbers. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colwright.columns import col, require
from colwright.llm.ranks import numbered
from colwright.llm.text import words
from colwright.sources.shared import kept

BUCKET_ROWS = 4096
FAN_IN = 64
MAX_COPIES = 2
SHARE = 1.5
EPSILON = 1e-9
CHANCES = 1 << 52


def text_words(text: Column) -> Column:
    """Size of a text in words, as bigint; null has none."""
    return F.size(words(F.coalesce(text, F.lit("")))).cast("bigint")


def cycle_weights(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2)) -> DataFrame:
    """Append weight: sources by code point, nulls last, take the weights in turn. One row per source is ranked."""
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    return sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn % len(weights)).cast("double"))


def targets(sizes: DataFrame, share: float = SHARE, most: float = MAX_COPIES) -> DataFrame:
    """Append target to a table with a row per source of source_size and weight.

    The targets add up to `share` of all sizes, in proportion to the weights. One that would
    exceed `most` times its source's size stops there, and the others share the excess by weight, until
    none is above. Each round stops one more source at least, so it ends. Only sums over the sources come to the driver.
    """
    cap = F.col("source_size") * F.lit(float(most))
    level, stopped = None, 0  # target per unit of weight of the sources that are not stopped, and how many are
    while True:
        full = F.lit(False) if level is None else cap < F.col("weight") * level
        row = sizes.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("caps"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weights"),
            F.count_if(full).alias("full"),
        ).first()
        if level is not None and row["full"] == stopped:
            break
        stopped = row["full"]
        if not row["weights"]:
            break
        level = max(0.0, share * (row["all"] or 0) - row["caps"]) / row["weights"]
    return sizes.withColumn("target", F.least(cap, F.col("weight") * F.lit(level or 0.0)))


def pivot(a: tuple, b: tuple, chance: float) -> tuple:
    """Move words between two open rows (fraction, size, what) until one is whole; that one comes first."""
    (p, s, x), (q, t, y) = a, b
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)  # words that the first can get, and give
    moved = up if chance * (up + down) < down else -down
    p, q = p + moved / s, q - moved / t
    if min(p, 1 - p) <= min(q, 1 - q):
        return (round(p), s, x), (q, t, y)
    return (round(q), t, y), (p, s, x)


def _round(last: bool):
    """Over batches sorted by source and bucket: settles all rows but one per bucket, or all on the last level.

    A batch's rows leave with the batch, but for the open one, which is carried on by itself.
    """

    def settled(rows: pa.RecordBatch, copies: list[int], fraction: list[float]) -> pa.RecordBatch:
        new = {
            "copies": pa.array(copies, pa.int64()),
            "fraction": pa.array(fraction, pa.float64()),
        }
        return pa.RecordBatch.from_arrays([new.get(f.name, rows.column(f.name)) for f in rows.schema], schema=rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, held_row = None, None, None  # held: fraction, size, (row number or -1, chance)

        def lone(copies: int, fraction: float) -> pa.RecordBatch:
            return settled(held_row, [held_row.column("copies")[0].as_py() + copies], [fraction])

        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            keys = list(zip(get("mix_source"), get("mix_bucket")))
            size, part, chance, copies = get("size"), get("fraction"), get("chance"), get("copies")
            fraction, gone, out = [0.0] * len(keys), None, []
            at = None if held is None else -1

            def settle(i: int, n: int, rest: float = 0.0) -> None:
                if i < 0:
                    out.append(lone(n, rest))
                else:
                    copies[i] += n
                    fraction[i] = rest

            def close() -> None:
                if held is not None:
                    p, _, (i, luck) = held
                    settle(i, int(luck < p), 0.0) if last else settle(i, 0, p)

            if held is not None:
                held = (held[0], held[1], (at, held[2][1]))
            for i, key in enumerate(keys):
                if key != here:
                    close()
                    here, held = key, None
                if size[i] <= 0:
                    continue
                if not EPSILON < part[i] < 1 - EPSILON:
                    copies[i] += round(part[i])
                    continue
                new = (part[i], size[i], (i, chance[i]))
                if held is None:
                    held = new
                    continue
                done, held = pivot(held, new, chance[i])
                settle(done[2][0], done[0])
                if not EPSILON < held[0] < 1 - EPSILON:
                    settle(held[2][0], round(held[0]))
                    held = None
            if held is not None and held[2][0] >= 0:
                gone = held[2][0]
            whole = settled(batch, copies, fraction)
            yield from out
            if gone is None:
                yield whole
            else:
                held_row = whole.slice(gone, 1)
                yield whole.slice(0, gone)
                yield whole.slice(gone + 1)
        if held is not None:
            yield lone(int(held[2][1] < held[0]), 0.0) if last else lone(0, held[0])

    return run


def _hashable(field: T.StructField) -> Column:
    """The column, as text if it holds maps, which Spark does not hash."""
    plain = not any(word in field.dataType.simpleString() for word in ("map<", "variant"))
    return col(field.name) if plain else F.to_json(F.struct(col(field.name)))


def _dealt_alike(rows: DataFrame) -> DataFrame:
    """Spreads marks with more rows than a bucket has over all buckets of their source, as many rows to each, whatever rows they are."""
    many = rows.groupBy(F.col("mark").alias("many")).count().filter(F.col("count") > BUCKET_ROWS)
    many = kept(many.select("many"), "mix-alike")
    if many.isEmpty():
        return rows
    marked = rows.join(many, F.col("mark") == F.col("many"), "left")
    alike = numbered(marked.filter("many IS NOT NULL"), "mark", [F.col("size")], "mix-alike")
    alike = alike.withColumn("mix_bucket", F.pmod(F.col("mark") + F.col("pos"), F.col("buckets"))).withColumn("mark", F.xxhash64("mark", "pos"))
    return marked.filter("many IS NULL").select(*rows.columns).unionByName(alike.select(*rows.columns))


def mix(
    df: DataFrame,
    size: Column,
    weigh: Callable[[DataFrame], DataFrame] = cycle_weights,
    source: str = "source",
    share: float = SHARE,
    seed: int = 7,
    payload: Sequence[str] | None = None,
) -> DataFrame:
    """The rows with size, source_size, target, copies and taken (copies times size) appended.

    `weigh` appends weight to a table with one row per source of source, source_size and rows.
    `payload` names the columns that come along, all of them by default.
    The new columns replace columns of their names.
    """
    require(df, source, *(payload or ()))
    added = ("size", "source_size", "target", "copies", "taken")
    own = [c for c in (payload or df.columns) if c.lower() not in added]
    rows = df.select(
        F.struct(*[col(c) for c in own]).alias("row"),
        col(source).cast("string").alias("mix_source"),
        size.alias("size"),
        F.xxhash64(F.lit(seed), *[_hashable(f) for f in df.schema.fields]).alias("mark"),
    )
    if payload:
        rows = kept(rows, "mix-rows")  # narrow: the texts are read and measured once
    sums = rows.groupBy(F.col("mix_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sums = kept(sums, "mix-sizes")
    goals = targets(weigh(sums), share).select(F.col("source").alias("goal_source"), "source_size", "target", "rows")
    # A hot source is split: its rows are dealt over buckets before anything gathers them.
    dealt = rows.join(goals, F.col("mix_source").eqNullSafe(F.col("goal_source")), "left")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(MAX_COPIES)), F.col("target") / F.col("source_size")))
    dealt = (
        dealt.withColumn("rate", F.coalesce(rate, F.lit(0.0)))
        .withColumn("copies", F.floor("rate"))
        .withColumn("fraction", F.col("rate") - F.floor("rate"))
        .withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS))
        .drop("rate", "goal_source", "rows")
    )
    dealt = _dealt_alike(dealt.withColumn("mix_bucket", F.pmod("mark", "buckets"))).drop("buckets")
    spread = -(-(sums.agg(F.max("rows")).first()[0] or 0) // BUCKET_ROWS)

    out, number = [], 0
    while True:
        last, number = spread <= 1, number + 1
        luck = F.pmod(F.xxhash64(F.lit(seed + number), "mark"), F.lit(CHANCES)) / F.lit(float(CHANCES))
        group = ["mix_source", "mix_bucket"]
        level = dealt.withColumn("chance", luck).repartition(*group).sortWithinPartitions(*group, "mark")
        done = level.mapInArrow(_round(last), level.schema)
        if last:
            out.append(done)
            break
        done = kept(done, "mixed")
        out.append(done.filter("fraction = 0"))
        dealt = done.filter("fraction > 0").withColumn("mix_bucket", F.floor(F.col("mix_bucket") / FAN_IN))
        spread = -(-spread // FAN_IN)
    mixed = reduce(DataFrame.unionByName, out)
    return mixed.select("row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
