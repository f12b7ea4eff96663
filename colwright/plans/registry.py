"""All operators by key, with what a recipe needs to know about each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from colwright.operators import binning, dates, encode, filters, impute, joins, numeric, profile, rank, scale, structure, text
from colwright.plans.fits import Fit
from colwright.sources import tables

# How an operator runs: on each row alone, on parameters fitted to the table, with a shuffle, or
# as the last step of a recipe, because what it returns is no longer the table.
ROW, FIT, SHUFFLE, CLOSING = "row", "fit", "shuffle", "closing"


@dataclass(frozen=True)
class Operator:
    run: Callable[..., DataFrame]
    kind: str = ROW
    # Adds or removes rows, so that later fits see another table.
    changes_rows: bool = False
    # What to fit; takes the table, the column and those arguments named in `fit_args`.
    fit: Callable[..., Fit] | None = None
    fit_args: tuple[str, ...] = ()


def _fit(run: Callable[..., DataFrame], fit: Callable[..., Fit], *fit_args: str, changes_rows: bool = False) -> Operator:
    return Operator(run, FIT, changes_rows, fit, fit_args)


def _rows(*functions: Callable[..., DataFrame]) -> dict[str, Operator]:
    return {f.__name__: Operator(f) for f in functions}


def _fewer(*functions: Callable[..., DataFrame]) -> dict[str, Operator]:
    return {f.__name__: Operator(f, changes_rows=True) for f in functions}


def _closing(function: Callable[..., DataFrame]) -> Operator:
    return Operator(function, CLOSING, changes_rows=True)


def _closing_whole(function: Callable[..., DataFrame]) -> Operator:
    """Of the table as a whole; the step's column is not looked at."""
    return _closing(lambda df, column, **args: function(df, **args))


OPERATORS: dict[str, Operator] = {
    **_rows(
        structure.drop_column,
        structure.drop_columns,
        structure.rename_column,
        structure.to_string,
        structure.to_integer,
        structure.concat_columns,
        structure.merge_columns,
    ),
    # Without `n` the schema depends on the data: the operator runs a job of its own.
    "split_column": Operator(structure.split_column, FIT),
    **_fewer(
        filters.filter_equal,
        filters.filter_not_equal,
        filters.filter_greater,
        filters.filter_greater_equal,
        filters.filter_less,
        filters.filter_less_equal,
        filters.filter_between,
        filters.filter_null,
        filters.filter_not_null,
        filters.filter_contains,
        filters.filter_startswith,
        filters.filter_endswith,
        filters.delete_negative,
        filters.delete_zero,
        filters.delete_null,
    ),
    **_rows(
        impute.replace_null_const,
        impute.replace_negative_const,
        impute.replace_zero_const,
        impute.replace_value,
    ),
    "replace_null_mean": _fit(impute.replace_null_mean, impute.fit_mean),
    "replace_null_median": _fit(impute.replace_null_median, impute.fit_median, "approx"),
    "replace_negative_mean": _fit(impute.replace_negative_mean, impute.fit_mean),
    "replace_negative_median": _fit(impute.replace_negative_median, impute.fit_median, "approx"),
    "replace_zero_mean": _fit(impute.replace_zero_mean, impute.fit_mean),
    "replace_zero_median": _fit(impute.replace_zero_median, impute.fit_median, "approx"),
    **_rows(
        text.upper,
        text.upper_new,
        text.lower,
        text.lower_new,
        text.initcap,
        text.trim,
        text.substring_new,
        text.replace_text,
        text.replace_text_new,
        numeric.sum_columns,
        numeric.sub_columns,
        numeric.mul_columns,
        numeric.div_columns,
        numeric.log_new,
        numeric.round_column,
        numeric.sqrt_new,
        numeric.square_new,
        numeric.ceil_new,
        numeric.floor_new,
        numeric.abs_new,
        dates.extract_year,
        dates.extract_month,
        dates.extract_day,
        dates.extract_hour,
        dates.extract_minute,
        dates.extract_second,
        dates.extract_day_of_week,
        dates.date_diff,
        dates.is_weekday,
        dates.is_leap_year,
        dates.parse_date,
        dates.change_date_format,
        binning.bin_labels,
    ),
    "scale_log": Operator(numeric.scale_log),
    "bin_percent": Operator(binning.bin_percent),
    "scale_standard": _fit(scale.scale_standard, scale.fit_standard, changes_rows=True),
    "scale_minmax": _fit(scale.scale_minmax, scale.fit_minmax, changes_rows=True),
    "scale_robust": _fit(scale.scale_robust, scale.fit_robust, "approx"),
    "bin_quantile": _fit(binning.bin_quantile, binning.fit_quantile, "approx"),
    "encode_category": _fit(encode.encode_category, encode.fit_categories),
    "sort_asc": Operator(rank.sort_asc, SHUFFLE),
    "sort_desc": Operator(rank.sort_desc, SHUFFLE),
    "sort_by_date": Operator(dates.sort_by_date, SHUFFLE),
    "pick_first_n": Operator(rank.pick_first_n, SHUFFLE, changes_rows=True),
    "pick_last_n": Operator(rank.pick_last_n, SHUFFLE, changes_rows=True),
    "deduplicate": Operator(rank.deduplicate, SHUFFLE, changes_rows=True),
    "join_tables": Operator(joins.join_tables, SHUFFLE, changes_rows=True),
    "column_min_max": _closing(profile.column_min_max),
    "column_mean": _closing(profile.column_mean),
    "column_describe": _closing(profile.column_describe),
    "distinct_values": _closing(profile.distinct_values),
    "distinct_count": _closing(profile.distinct_count),
    "max_split_size": _closing(structure.max_split_size),
    "column_profile": _closing_whole(profile.column_profile),
    "column_metadata": _closing_whole(profile.column_metadata),
    "row_count": _closing_whole(profile.row_count),
    "table_size": _closing_whole(profile.table_size),
    "preview": _closing_whole(tables.preview),
    "preview_random": _closing_whole(tables.preview_random),
}

# Operation ids found in recorded recipes, and the operators they stand for.
RECORDED_IDS = {
    "upper_case": "upper",
    "upper_case_feature": "upper_new",
    "lower_case_feature": "lower_new",
    "feature_concat": "concat_columns",
    "feature_substr": "substring_new",
    "lower_case": "lower",
    "ascending": "sort_asc",
    "descending": "sort_desc",
    "change_date": "change_date_format",
    "trailing_space": "trim",
    "to_string": "to_string",
    "to_integer": "to_integer",
    "delete": "drop_column",
    "rename": "rename_column",
    "replace_string": "replace_text",
    "replace_string_constant": "replace_text_new",
    "categorical": "encode_category",
    "split": "split_column",
    "bining": "bin_labels",
    "per_bining": "bin_percent",
    "replace_int_constant": "replace_value",
    "feature_log": "log_new",
    "feature_sum": "sum_columns",
    "feature_sub": "sub_columns",
    "feature_mul": "mul_columns",
    "feature_div": "div_columns",
    "quantile": "bin_quantile",
    "scaling_normal": "scale_standard",
    "scaling_minmax": "scale_minmax",
    "scaling_robust": "scale_robust",
    "scaling_log": "scale_log",
    "update_null": "replace_null_const",
    "update_negative": "replace_negative_const",
    "update_zero": "replace_zero_const",
    "delete_negative": "delete_negative",
    "delete_zero": "delete_zero",
    "delete_null": "delete_null",
    "filter_equal": "filter_equal",
    "filter_not_equal": "filter_not_equal",
    "filter_greater": "filter_greater",
    "filter_greater_equal": "filter_greater_equal",
    "filter_lesser": "filter_less",
    "filter_lesser_equal": "filter_less_equal",
    "filter_between": "filter_between",
    "filter_null": "filter_null",
    "filter_not_null": "filter_not_null",
    "filter_contains": "filter_contains",
    "delete_mul": "drop_columns",
}


def operator(key: str) -> tuple[str, Operator]:
    """Key and operator for a key or a recorded id."""
    key = RECORDED_IDS.get(key, key)
    if key not in OPERATORS:
        raise ValueError(f"unknown operator {key!r}")
    return key, OPERATORS[key]
