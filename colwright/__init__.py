"""Table wrangling and feature engineering as native Spark queries.

Every operator is a function `DataFrame, column, ... -> DataFrame`.
"""

from colwright.operators.binning import bin_labels, bin_percent, bin_quantile
from colwright.operators.dates import (
    change_date_format,
    date_diff,
    extract_day,
    extract_day_of_week,
    extract_hour,
    extract_minute,
    extract_month,
    extract_second,
    extract_year,
    is_leap_year,
    is_weekday,
    parse_date,
    sort_by_date,
)
from colwright.operators.encode import encode_category
from colwright.operators.filters import (
    delete_negative,
    delete_null,
    delete_zero,
    filter_between,
    filter_contains,
    filter_endswith,
    filter_equal,
    filter_greater,
    filter_greater_equal,
    filter_less,
    filter_less_equal,
    filter_not_equal,
    filter_not_null,
    filter_null,
    filter_startswith,
)
from colwright.operators.impute import (
    replace_negative_const,
    replace_negative_mean,
    replace_negative_median,
    replace_null_const,
    replace_null_mean,
    replace_null_median,
    replace_value,
    replace_zero_const,
    replace_zero_mean,
    replace_zero_median,
)
from colwright.operators.joins import join_tables
from colwright.operators.numeric import (
    abs_new,
    ceil_new,
    div_columns,
    floor_new,
    log_new,
    mul_columns,
    round_column,
    scale_log,
    sqrt_new,
    square_new,
    sub_columns,
    sum_columns,
)
from colwright.operators.profile import (
    column_count,
    column_describe,
    column_mean,
    column_metadata,
    column_min_max,
    column_profile,
    distinct_count,
    distinct_values,
    row_count,
    table_size,
)
from colwright.operators.rank import deduplicate, pick_first_n, pick_last_n, sort_asc, sort_desc
from colwright.operators.scale import scale_minmax, scale_robust, scale_standard
from colwright.operators.structure import (
    concat_columns,
    drop_column,
    drop_columns,
    max_split_size,
    merge_columns,
    rename_column,
    split_column,
    to_integer,
    to_string,
)
from colwright.operators.text import (
    initcap,
    lower,
    lower_new,
    replace_text,
    replace_text_new,
    substring_new,
    trim,
    upper,
    upper_new,
)
from colwright.plans.recipe import Step, apply_recipe, fit_recipe, load_recipe, save_recipe, steps_of, steps_table
from colwright.sources.shared import owned_tables
from colwright.sources.tables import preview, preview_random, read_csv, read_parquet, restore_table, save_table
from colwright.streaming.replay import apply_to_stream
