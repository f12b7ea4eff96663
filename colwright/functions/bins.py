"""Bin edges, labels and quantile buckets as native expressions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_edges(starts: Sequence[Any], ends: Sequence[Any]) -> list[float]:
    """All start values plus the last end value, strictly increasing.

    Only the last end counts: a bin reaches up to the next start, so a gap
    between two bins belongs to the lower one.
    """
    if not starts or not ends:
        raise ValueError("bins need start values and an end value")
    edges = [float(s) for s in starts] + [float(ends[-1])]
    if any(a >= b for a, b in zip(edges, edges[1:])):
        raise ValueError(f"bin edges must increase strictly, got {edges}")
    return edges


def labelled_bin(c: Column, edges: Sequence[float], labels: Sequence[str], outside: Column) -> Column:
    """Label of the half-open bin that holds the value; the last bin is closed."""
    x = c.cast("double")
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    out = out.when((x < edges[0]) | (x > edges[-1]), outside)
    for upper, label in zip(edges[1:-1], labels):
        out = out.when(x < upper, F.lit(label))
    return out.otherwise(F.lit(labels[len(edges) - 2]))


def bucket_number(c: Column, cuts: Sequence[Column]) -> Column:
    """Number of distinct cut points at or below the value, as a double; null stays null."""
    passed = F.lit(0.0)
    for i, cut in enumerate(cuts):
        new = F.lit(True) if i == 0 else cut != cuts[i - 1]
        passed = passed + F.when(new & (c >= cut), 1.0).otherwise(0.0)
    return F.when(c.isNotNull(), passed)
