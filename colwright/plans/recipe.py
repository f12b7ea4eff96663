"""Recipes: a recorded list of steps, replayed on any table as one Spark query."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from colwright.plans.fits import Fit, Params, settle
from colwright.plans.registry import CLOSING, FIT, SHUFFLE, Operator, operator
from colwright.sources.shared import kept


@dataclass(frozen=True)
class Step:
    """One operator call. `params`, once fitted, makes a fitted operator row-local."""

    op: str
    column: str | Sequence[str]
    args: Mapping[str, Any] = field(default_factory=dict)
    params: Params | None = None


Tables = Mapping[str, DataFrame]


def apply_recipe(df: DataFrame, steps: Iterable[Step], tables: Tables | None = None) -> DataFrame:
    """Apply the steps in order.

    Fits run when it is called, those that look at the same state of the table in one scan. Steps that
    come with their parameters are applied as they are; steps without fits run nothing. Where fits follow a join, sort or pick, the
    rows after it are kept once for all of them and for the result. A join step names its right table as `right`, to be found
    in `tables`.
    """
    return _replay(df, steps, tables or {})[0]


def fit_recipe(df: DataFrame, steps: Iterable[Step], tables: Tables | None = None) -> list[Step]:
    """Fit all steps on this table, for use on others: one job per round of independent fits."""
    return _replay(df, steps, tables or {})[1]


def _replay(
    df: DataFrame, steps: Iterable[Step], tables: Tables
) -> tuple[DataFrame, list[Step]]:
    """Collect steps while all fits among them see the same table, then fit and apply them."""
    done: list[Step] = []
    waiting: list[tuple[Step, Fit | None]] = []
    written: set[str] = set()
    rows_changed = shuffled = False

    def catch_up(more: bool) -> DataFrame:
        nonlocal rows_changed, shuffled
        fits = [fit for _, fit in waiting if fit is not None]
        found = iter(settle(df, fits, lazy=False) if fits else [])
        out = df
        for step, fit in waiting:
            if fit is not None:
                step = replace(step, params=next(found))
            out, step = _call(out, step, tables)
            done.append(step)
            op = operator(step.op)[1]
            if op.kind == SHUFFLE:
                # A sort must stay in the plan: rows that were written do not come back in order.
                shuffled = op.changes_rows
        waiting.clear()
        written.clear()
        rows_changed = False
        if more and shuffled:
            # Later fits and the result share these rows, else each would join or sort again.
            out, shuffled = kept(out, "recipe"), False
        return out

    closed = None
    for step in steps:
        key, op = operator(step.op)
        if closed:
            raise ValueError(f"step {step.op} comes after {closed}, which ends a recipe")
        closed = key if op.kind == CLOSING else None
        step = replace(step, op=key)
        fit = None
        if op.fit is not None and step.params is None:
            if rows_changed or step.column in written or step.column not in df.columns:
                df = catch_up(True)
            chosen = {name: step.args[name] for name in op.fit_args if name in step.args}
            fit = op.fit(df, step.column, **chosen)
        waiting.append((step, fit))
        rows_changed |= op.changes_rows
        written.update(_writes(step))
    return catch_up(False), done


def _writes(step: Step) -> set[str]:
    columns = {step.column} if isinstance(step.column, str) else set(step.column)
    return columns | {step.args["new_column"]} if "new_column" in step.args else columns


def _call(df: DataFrame, step: Step, tables: Tables) -> tuple[DataFrame, Step]:
    _, op = operator(step.op)
    args = dict(step.args)
    if "right" in args:
        if args["right"] not in tables:
            raise ValueError(f"step {step.op}: no table {args['right']!r} was given")
        args["right"] = tables[args["right"]]
    if op.fit is not None:
        args["params"] = step.params
    try:
        out = _run(df, op, step, args)
    except ValueError as e:
        raise ValueError(f"step {step.op} on {step.column}: {e}") from e
    if step.op == "split_column" and "n" not in step.args:
        pieces = len(out.columns) - len(df.columns)
        step = replace(step, args={**step.args, "n": pieces})
    return out, step


def _run(df: DataFrame, op: Operator, step: Step, args: dict[str, Any]) -> DataFrame:
    if "right" in args:
        return op.run(df, args.pop("right"), step.column, **args)
    return op.run(df, step.column, **args)


def row_local(step: Step) -> bool:
    """Whether the step works on each row alone: no shuffle, no fit still to be done."""
    _, op = operator(step.op)
    if op.fit is not None:
        return step.params is not None
    if op.kind == FIT:
        return "n" in step.args
    return op.kind == "row"


def steps_table(spark: SparkSession, steps: Iterable[Step]) -> DataFrame:
    """The steps as a table: `step`, `op`, and `column`, `args` and `params` as JSON."""
    rows = [
        (i, s.op, json.dumps(s.column), json.dumps(dict(s.args)), None if s.params is None else json.dumps(s.params))
        for i, s in enumerate(steps)
    ]
    return spark.createDataFrame(rows, "step int, op string, column string, args string, params string")


def steps_of(table: DataFrame) -> list[Step]:
    """The steps of such a table, in order. A recipe has as many rows as it has steps."""
    return [
        Step(r.op, json.loads(r.column), json.loads(r.args), None if r.params is None else json.loads(r.params))
        for r in table.orderBy("step").collect()
    ]


def save_recipe(spark: SparkSession, steps: Iterable[Step], path: str) -> None:
    """Save the steps below `path`, and with them copies of the category tables that their parameters name."""
    saved = []
    for i, step in enumerate(steps):
        categories = (step.params or {}).get("categories")
        if categories:
            copy = f"tables/{i}"
            spark.read.parquet(categories["table"]).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{copy}")
            step = replace(step, params={**step.params, "categories": {**categories, "table": copy}})
        saved.append(step)
    steps_table(spark, saved).write.mode("overwrite").parquet(f"{path.rstrip('/')}/steps")


def load_recipe(spark: SparkSession, path: str) -> list[Step]:
    """The steps of a saved recipe, whose tables are those saved with it."""
    steps = []
    for step in steps_of(spark.read.parquet(f"{path.rstrip('/')}/steps")):
        categories = (step.params or {}).get("categories")
        if categories:
            table = f"{path.rstrip('/')}/{categories['table']}"
            step = replace(step, params={**step.params, "categories": {**categories, "table": table}})
        steps.append(step)
    return steps
