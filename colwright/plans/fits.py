"""How the fitted operators get their parameters.

A fit is described by a dictionary from parameter name to either an aggregate
expression or a job. Aggregates of one fit are computed together, as one struct:

* lazily, as a scalar subquery of the plan. It scans only the columns it needs,
  runs once per query, and its one-row result becomes a value in the generated
  code: no join and no driver round trip;
* or up front, as one aggregation whose single row supplies literals. That keeps
  the plan flat when many fits build on each other.

Jobs (exact quantiles, category lists) depend on the data in more than one step
and always run up front.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colwright.plans.quantiles import Quantiles, exact_quantiles


class Job(Protocol):
    def run(self, df: DataFrame) -> Any: ...


Fit = Mapping[str, "Column | Quantiles | Job"]
Params = dict[str, Any]


def present(values: Column) -> Column:
    """The values as double; NaN counts as missing, in every fit."""
    x = values.cast("double")
    return F.when(~F.isnan(x), x)


def quantiles(values: Column, fractions: Sequence[float], interpolate: bool, approx: bool) -> Column | Quantiles:
    """Quantiles to put into a fit; the approximate form is an ordinary one-pass aggregate."""
    if not approx:
        return Quantiles(values, fractions, interpolate)
    return F.percentile_approx(present(values), list(fractions), 10_000)


def settle(df: DataFrame, fits: Sequence[Fit], lazy: bool = True) -> list[Params]:
    """Parameters of several fits over the same table.

    All aggregates share one scan, and so do all exact quantiles in each of their passes.
    """
    parts = {(i, name): part for i, fit in enumerate(fits) for name, part in fit.items()}
    found: dict[tuple[int, str], Any] = {}

    aggregates = {key: part for key, part in parts.items() if isinstance(part, Column)}
    if aggregates:
        names = {key: f"p{key[0]}_{key[1]}" for key in aggregates}
        one_row = df.agg(F.struct(*[part.alias(names[key]) for key, part in aggregates.items()]).alias("fit"))
        fit = one_row.scalar() if lazy else one_row.first().fit
        found.update({key: fit[name] for key, name in names.items()})

    ranked = {key: part for key, part in parts.items() if isinstance(part, Quantiles)}
    if ranked:
        # Decimals become text, so that parameters can be saved; `value` takes a type to read them with.
        texts = [[str(q) if isinstance(q, Decimal) else q for q in qs] for qs in exact_quantiles(df, list(ranked.values()))]
        found.update(zip(ranked, texts))

    for key, part in parts.items():
        if key not in found:
            found[key] = part.run(df)
    return [{name: found[i, name] for name in fit} for i, fit in enumerate(fits)]


def fitted(df: DataFrame, fit: Fit, params: Params | None) -> Params:
    """Parameters given by the caller (from an earlier fit), or a lazy fit on the table."""
    return params if params is not None else settle(df, [fit])[0]


def value(param: Any, kind: T.DataType | None = None) -> Column:
    """A parameter as a column, whether it is a subquery field or a plain number; of a type, if one is given."""
    found = param if isinstance(param, Column) else F.lit(param)
    return found if kind is None else found.try_cast(kind)
