"""Recipes: several operators as one query."""

from __future__ import annotations

import colwright as cw
from colwright import Step
from workload import Tables, query

# Negative balances become the mean, then balances are stretched to 0..1, segments
# capitalised, nations joined, and the three largest balances per nation picked.
FLAGSHIP = [
    Step("replace_negative_mean", "c_acctbal"),
    Step("scale_minmax", "c_acctbal", {"new_column": "scaled"}),
    Step("initcap", "c_mktsegment"),
    Step("join_tables", "c_nationkey", {"right": "nation", "right_on": "n_nationkey"}),
    Step("pick_first_n", "n_name", {"order_column": "scaled", "n": 3}),
]


def flagship(t: Tables):
    return cw.round_column(cw.apply_recipe(t.customer, FLAGSHIP, {"nation": t.nation}), "c_acctbal", 4)


query(
    "apply_recipe",
    """WITH filled AS (SELECT * REPLACE (CASE WHEN c_acctbal < 0 THEN (SELECT avg(c_acctbal) FROM customer)
                                          ELSE c_acctbal END AS c_acctbal) FROM customer),
            scaled AS (SELECT *, round((c_acctbal - (SELECT min(c_acctbal) FROM filled))
                              / ((SELECT max(c_acctbal) FROM filled) - (SELECT min(c_acctbal) FROM filled)), 4) AS scaled
                       FROM filled),
            ranked AS (SELECT c_nationkey, c_custkey, c_name, round(c_acctbal, 4) AS c_acctbal,
                              upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS c_mktsegment, scaled, n_name,
                              n_regionkey, cast(rank() OVER (PARTITION BY n_name ORDER BY scaled DESC) AS INTEGER) AS rank
                       FROM scaled JOIN nation ON c_nationkey = n_nationkey)
       SELECT * FROM ranked WHERE rank <= 3""",
)(flagship)


@query(
    "apply_recorded_recipe",
    """SELECT l_orderkey, l_linenumber, l_quantity, upper(l_linestatus) AS l_linestatus, 'flag ' || l_returnflag AS flag,
              round(CASE WHEN l_extendedprice > 0 THEN ln(l_extendedprice) END, 4) AS log_price,
              l_extendedprice * l_discount AS saved
       FROM lineitem WHERE l_discount <> 0 AND l_quantity BETWEEN 5 AND 45 ORDER BY l_quantity DESC""",
)
def recorded(t):
    # Steps under the ids and labels that existing recordings hold.
    steps = [
        Step("delete_zero", "l_discount"),
        Step("filter_between", "l_quantity", {"start": "5", "end": "45"}),
        Step("upper_case", "l_linestatus"),
        Step("replace_string_constant", "l_returnflag", {"search": "^", "replacement": "flag ", "new_column": "flag"}),
        Step("feature_log", "l_extendedprice", {"new_column": "log price"}),
        Step("feature_mul", ["l_extendedprice", "l_discount"], {"new_column": "saved"}),
        Step("delete_mul", ["l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"]),
        Step("descending", "l_quantity"),
    ]
    return cw.apply_recipe(t.lineitem, steps)


@query(
    "fit_recipe",
    """SELECT s_suppkey, s_nationkey,
              round(s_acctbal / (SELECT stddev_samp(c_acctbal) FROM customer), 4) AS standard,
              round((s_acctbal - (SELECT median(c_acctbal) FROM customer))
                    / (SELECT quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) FROM customer), 4) AS robust,
              cast((s_acctbal >= (SELECT quantile_disc(c_acctbal, 0.25) FROM customer))::INT
                   + (s_acctbal >= (SELECT quantile_disc(c_acctbal, 0.5) FROM customer))::INT
                   + (s_acctbal >= (SELECT quantile_disc(c_acctbal, 0.75) FROM customer))::INT AS DOUBLE) AS quartile
       FROM supplier""",
)
def fitted(t):
    # Fitted on the customers, stored and loaded as a table, applied to the suppliers.
    steps = [
        Step("scale_robust", "acctbal", {"new_column": "robust"}),
        Step("bin_quantile", "acctbal", {"new_column": "quartile"}),
        Step("scale_standard", "acctbal", {"new_column": "standard"}),
        Step("drop_column", "acctbal"),
    ]
    known = cw.fit_recipe(cw.rename_column(t.customer, "c_acctbal", "acctbal"), steps)
    stored = cw.steps_table(t.spark, known)
    suppliers = cw.rename_column(cw.drop_column(t.supplier, "s_name"), "s_acctbal", "acctbal")
    return cw.apply_recipe(suppliers, cw.steps_of(stored))


@query(
    "apply_recipe_closed_by_count",
    "SELECT count(DISTINCT upper(l_linestatus) || l_returnflag) AS distinct_count FROM lineitem WHERE l_discount <> 0",
)
def closed_by_count(t):
    steps = [
        Step("delete_zero", "l_discount"),
        Step("upper", "l_linestatus"),
        Step("concat_columns", ["l_linestatus", "l_returnflag"], {"new_column": "both"}),
        Step("distinct_count", "both"),
    ]
    return cw.apply_recipe(t.lineitem, steps)


@query(
    "apply_recipe_closed_by_profile",
    """WITH kept AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0)
       SELECT 'c_custkey' AS column_name, CASE WHEN count(DISTINCT c_custkey) <= count(*) / 10 THEN 'classification'
              ELSE 'continuous' END AS ftype, 'integer' AS type, 0 AS rank FROM kept
       UNION ALL SELECT 'c_nationkey', CASE WHEN count(DISTINCT c_nationkey) <= count(*) / 10 THEN 'classification'
              ELSE 'continuous' END, 'integer', 1 FROM kept""",
)
def closed_by_profile(t):
    steps = [
        Step("filter_greater", "c_acctbal", {"value": 0}),
        Step("delete_mul", ["c_name", "c_acctbal", "c_mktsegment"]),
        Step("column_profile", ""),
    ]
    return cw.apply_recipe(t.customer, steps)
