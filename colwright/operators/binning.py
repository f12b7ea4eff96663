"""Binning into labelled intervals or quartiles."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colwright.columns import add_column, as_list, col, fresh_name, is_numeric, type_of
from colwright.functions.bins import bin_edges, bucket_number, labelled_bin
from colwright.plans.fits import Fit, Params, fitted, quantiles, value
from colwright.plans.quantiles import exact_type


def _need_number(df: DataFrame, column: str) -> None:
    if not is_numeric(df, column):
        raise ValueError(f"column {column!r} is not numeric")


def bin_labels(
    df: DataFrame,
    column: str,
    starts: Sequence[Any],
    ends: Sequence[Any],
    labels: Sequence[str],
    new_column: str,
    *,
    on_outside: str = "error",
    after: str | None = None,
) -> DataFrame:
    """Label each value with the bin it falls into.

    Bins are closed below and open above, the last one closed on both sides; of
    the ends only the last counts. Null stays null. A value outside all bins
    fails the query, or becomes null with `on_outside="null"`.
    """
    _need_number(df, column)
    edges, labels = bin_edges(starts, ends), as_list(labels)
    if len(labels) != len(edges) - 1:
        raise ValueError(f"{len(edges) - 1} bins need as many labels, got {len(labels)}")
    if on_outside == "error":
        outside = F.raise_error(F.concat(F.lit(f"value outside the bins of {column}: "), col(column).cast("string")))
    elif on_outside == "null":
        outside = F.lit(None)
    else:
        raise ValueError(f"on_outside is 'error' or 'null', not {on_outside!r}")
    return add_column(df, new_column, labelled_bin(col(column), edges, labels, outside.cast("string")), after)


# The same operation under its second name; despite the name it knows no percentages.
bin_percent = bin_labels


def fit_quantile(df: DataFrame, column: str, approx: bool = False) -> Fit:
    _need_number(df, column)
    return {"cuts": quantiles(col(column), [0.25, 0.5, 0.75], interpolate=False, approx=approx)}


def bin_quantile(
    df: DataFrame,
    column: str,
    new_column: str,
    *,
    approx: bool = False,
    after: str | None = None,
    params: Params | None = None,
) -> DataFrame:
    """Quartile bucket 0.0 to 3.0: the number of distinct quartile cuts at or below the value."""
    fresh_name(df, new_column)
    found = fitted(df, fit_quantile(df, column, approx), params)["cuts"]
    kind = exact_type(type_of(df, column)) or T.DoubleType()
    return add_column(df, new_column, bucket_number(col(column).cast(kind), [value(found[i], kind) for i in range(3)]), after)
