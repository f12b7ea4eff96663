"""Replaying a recipe on a stream.

Filters, projections and fitted steps work on each row alone, so they run on a
streaming DataFrame exactly as on a table: stateless, in append mode, with no
watermark to choose. Fit the recipe on a table first (`fit_recipe`).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from colwright.plans.recipe import Step, apply_recipe, row_local


def apply_to_stream(stream: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """Apply row-local and fitted steps to a streaming table; refuse all others."""
    if not stream.isStreaming:
        raise ValueError("not a streaming table; use apply_recipe")
    steps = list(steps)
    blocked = [s.op for s in steps if not row_local(s)]
    if blocked:
        raise ValueError(f"steps that a stream cannot run: {blocked}; fit the recipe on a table, or leave them out")
    return apply_recipe(stream, steps)
