"""Exact quantiles of columns of any size.

Spark's own exact percentile keeps every distinct value of the column in the
memory of one task, and its approximate one is approximate. Here the wanted
ranks are narrowed down instead: each pass counts the rows per value bucket (a
group-by of at most a few thousand groups, combined on the map side) and
zooms into the buckets that hold the ranks, until such a bucket holds a single
value. Nothing but those counts is ever shuffled, and a hot value costs nothing
extra because it is one group. Several columns share every pass.

The table itself is read once: its wanted columns, and no others, are written to the shared
folder, every pass reads those, and they are removed at the end. Big integers and decimals are
compared and returned as decimals, with all their digits; everything else as doubles.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal, localcontext
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colwright.sources.shared import briefly_kept

# Buckets per zoomed range; bounds the groups of a pass and hence its ranking window.
BUCKETS = 4096

# More digits than any two decimals and their mean have.
DIGITS = 80

Number = float | Decimal
Span = tuple[Number, Number]


def exact_type(kind: T.DataType) -> T.DecimalType | None:
    """The decimal type that holds all values of a type which double does not; null for other types."""
    if isinstance(kind, T.LongType):
        return T.DecimalType(19, 0)
    return kind if isinstance(kind, T.DecimalType) else None


@dataclass(frozen=True)
class Quantiles:
    """Quantiles of the non-null, non-NaN values of an expression.

    With `interpolate` a quantile between two rows is interpolated linearly,
    otherwise it is the smallest value with at least that fraction at or below it.
    """

    values: Column
    fractions: Sequence[float]
    interpolate: bool

    def places(self, rows: int) -> list[float]:
        """Where the quantiles stand among that many sorted rows, counted from 1."""
        if self.interpolate:
            return [f * (rows - 1) + 1 for f in self.fractions]
        return [max(1, math.ceil(f * rows)) for f in self.fractions]


@dataclass
class _Search:
    """State of one column: for each wanted rank the range its value is known to lie in."""

    number: int
    kind: str
    rows: int
    places: list[float]
    spans: dict[int, Span] = field(default_factory=dict)

    @property
    def open_ranks(self) -> list[int]:
        return [rank for rank, (lo, hi) in self.spans.items() if lo < hi]

    @property
    def open_spans(self) -> list[Span]:
        return sorted({self.spans[rank] for rank in self.open_ranks})

    def result(self) -> list[Number | None]:
        if not self.rows:
            return [None for _ in self.places]
        out: list[Number | None] = []
        for place in self.places:
            below, above = self.spans[math.floor(place)][0], self.spans[math.ceil(place)][0]
            share = type(below)(place - math.floor(place))
            with localcontext() as context:
                context.prec = DIGITS
                out.append(below if share == 0 or below == above else (1 - share) * below + share * above)
        return out


def exact_quantiles(df: DataFrame, wanted: Sequence[Quantiles]) -> list[list[Number | None]]:
    """For each request its quantiles, or nulls where the column has no values."""
    names = [f"v{i}" for i in range(len(wanted))]
    types = [f.dataType for f in df.select(*[q.values.alias(name) for q, name in zip(wanted, names)]).schema]
    values = []
    for q, kind in zip(wanted, types):
        exact, double = exact_type(kind), q.values.cast("double")
        values.append(q.values.cast(exact) if exact else F.when(~F.isnan(double), double))
    with briefly_kept(df.select(*[v.alias(name) for v, name in zip(values, names)]), "quantiles") as data:
        return _find(data, names, wanted)


def _find(data: DataFrame, names: Sequence[str], wanted: Sequence[Quantiles]) -> list[list[Number | None]]:
    ends = data.agg(
        *[F.struct(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).alias(v) for v in names]
    ).first()

    searches = []
    for i, (q, end) in enumerate(zip(wanted, ends)):
        places = q.places(end.n)
        ranks = {r for p in places for r in (math.floor(p), math.ceil(p))} if end.n else set()
        kind = data.schema[i].dataType.simpleString()
        searches.append(_Search(i, kind, end.n, places, dict.fromkeys(ranks, (end.lo, end.hi))))

    while still_open := [s for s in searches if s.open_ranks]:
        before = [dict(s.spans) for s in still_open]
        _narrow(data, still_open)
        if before == [s.spans for s in still_open]:
            raise RuntimeError("the table changes while its quantiles are computed: write it down first")
    return [s.result() for s in searches]


def _narrow(data: DataFrame, searches: Sequence[_Search]) -> None:
    """One pass over the data: find the bucket of each wanted rank."""
    kinds = sorted({s.kind for s in searches})
    cells = []
    for s in searches:
        v = F.col(f"v{s.number}")
        # A field per type, so that no value is cast to another column's.
        fields = [(v if s.kind == kind else F.lit(None).cast(kind)).alias(f"v{k}") for k, kind in enumerate(kinds)]
        bucket = F.when(v.isNotNull(), _bucket(v, s.open_spans)).cast("double").alias("bucket")
        cells.append(F.struct(F.lit(s.number).alias("i"), bucket, *fields))
    counts = (
        data.select(F.inline(F.array(*cells)))
        .where(F.col("bucket").isNotNull())
        .groupBy("i", "bucket")
        .agg(
            F.count("*").alias("n"),
            *[F.min(f"v{k}").alias(f"lo{k}") for k in range(len(kinds))],
            *[F.max(f"v{k}").alias(f"hi{k}") for k in range(len(kinds))],
        )
    )
    # Bucket counts only: a few times BUCKETS rows per column. Bucket numbers grow with the values.
    sorted_ = Window.partitionBy("i").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    holds = [
        (F.col("i") == s.number) & (F.col("upto") - F.col("n") < rank) & (F.col("upto") >= rank)
        for s in searches
        for rank in s.open_ranks
    ]
    hits = counts.withColumn("upto", F.sum("n").over(sorted_)).where(reduce(lambda a, b: a | b, holds))
    found = hits.collect()  # one row per wanted rank at most
    for s in searches:
        k = kinds.index(s.kind)
        for row in found:
            for rank in s.open_ranks:
                if row.i == s.number and row.upto - row.n < rank <= row.upto:
                    s.spans[rank] = (row[f"lo{k}"], row[f"hi{k}"])


def _bucket(v: Column, spans: Sequence[Span]) -> Column:
    """Bucket number that grows with the value: fine inside the spans, one number per gap.

    The two ends of a span are buckets of their own, so every pass shrinks every
    span even if all its inner values fall into one bucket.
    """
    out: Column | None = None
    for i, (lo, hi) in enumerate(spans):
        base = i * (BUCKETS + 4)
        out = F.when(v < lo, base) if out is None else out.when(v < lo, base)
        inner = F.when(v == lo, 0).when(v == hi, BUCKETS + 2).otherwise(_inside(v, lo, hi))
        out = out.when(v <= hi, base + 1 + inner)
    return out.otherwise(len(spans) * (BUCKETS + 4))


def _inside(v: Column, lo: Number, hi: Number) -> Column:
    """Bucket 1 to BUCKETS + 1 of a value strictly between the ends.

    Buckets are evenly wide where the ends are close to each other and grow with
    the value where they are not, so that one absurd outlier does not push all else
    into a single bucket. A span across zero is cut there.
    """
    lo, hi = max(lo, -sys.float_info.max), min(hi, sys.float_info.max)
    half, x = BUCKETS // 2, v.cast("double")
    if lo <= 0 <= hi:
        below = half - _step(F.log1p(-x), 0.0, math.log1p(-lo), half)
        above = half + 2 + _step(F.log1p(x), 0.0, math.log1p(hi), half)
        return F.when(v < 0, below).when(v == 0, half + 1).otherwise(above)
    if hi < 0:
        return BUCKETS + 1 - _inside(-v, -hi, -lo)
    if hi / lo > 4:
        return 1 + _step(F.ln(x), math.log(lo), math.log(hi), BUCKETS)
    # The difference is taken before digits are lost.
    return 1 + _step((v - F.lit(lo)).cast("double"), 0.0, float(hi - lo), BUCKETS)


def _step(place: Column, start: float, end: float, steps: int) -> Column:
    """Which of equally wide steps between start and end the place is in, from 0."""
    if not end > start:
        return F.lit(0)
    share = (place - start) / F.lit(end - start)
    return F.greatest(F.lit(0), F.least(F.lit(steps - 1), F.floor(share * steps)))
