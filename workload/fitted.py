"""Operators with parameters fitted to the whole table, and the statistics themselves."""

from __future__ import annotations

import colwright as cw
from workload import query
from workload.filters import GAPPED, gapped_events

GAPPED_EVENTS = f"(SELECT event_id, {GAPPED} AS value FROM events)"
MEAN = "(SELECT avg({0}) FROM {1})"
MEDIAN = "(SELECT quantile_cont({0}, 0.5) FROM {1})"


# Imputation. Means are rounded: the two engines add up in different orders.


def _impute(key: str, table: str, row: str, column: str, hit: str, by: str) -> None:
    source = GAPPED_EVENTS if table == "events" else table
    impute = getattr(cw, key)

    @query(
        key,
        f"""SELECT {row}, round(CASE WHEN {column} {hit} THEN {by.format(column, source)} ELSE {column} END, 4)
            AS {column} FROM {source}""",
    )
    def build(t):
        df = gapped_events(t) if table == "events" else getattr(t, table)
        return cw.round_column(impute(df, column), column, 4).select(*row.split(", "), column)


_impute("replace_null_mean", "events", "event_id", "value", "IS NULL", MEAN)
_impute("replace_null_median", "events", "event_id", "value", "IS NULL", MEDIAN)
_impute("replace_negative_mean", "customer", "c_custkey", "c_acctbal", "< 0", MEAN)
_impute("replace_negative_median", "customer", "c_custkey", "c_acctbal", "< 0", MEDIAN)
_impute("replace_zero_mean", "lineitem", "l_orderkey, l_linenumber", "l_discount", "= 0", MEAN)
_impute("replace_zero_median", "lineitem", "l_orderkey, l_linenumber", "l_discount", "= 0", MEDIAN)


@query(
    "replace_zero_median_decimal",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_discount, row_number() OVER (ORDER BY l_discount) AS k, count(*) OVER () AS n FROM lineitem),
            m AS (SELECT avg(l_discount) AS median FROM x WHERE k IN ((n + 1) // 2, n // 2 + 1))
       SELECT l_orderkey, l_linenumber,
              CAST(CAST(CASE WHEN l_discount = 0 THEN (SELECT median FROM m) ELSE l_discount END AS DECIMAL(12, 4)) AS VARCHAR) AS l_discount
       FROM lineitem""",
)
def replace_zero_median_decimal(t):
    exact = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "cast(l_discount AS decimal(12,4)) AS l_discount")
    return cw.to_string(cw.replace_zero_median(exact, "l_discount"), "l_discount")


# Scaling


@query(
    "scale_standard",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice / (SELECT stddev_samp(l_extendedprice) FROM lineitem), 4)
              AS scaled FROM lineitem""",
)
def scale_standard(t):
    return cw.scale_standard(t.lineitem, "l_extendedprice", "scaled").select("l_orderkey", "l_linenumber", "scaled")


@query(
    "scale_standard_nulls",
    f"""SELECT event_id, round(value / (SELECT stddev_samp(value) FROM {GAPPED_EVENTS}), 4) AS scaled
        FROM {GAPPED_EVENTS} WHERE value IS NOT NULL""",
)
def scale_standard_nulls(t):
    return cw.scale_standard(gapped_events(t), "value", "scaled").select("event_id", "scaled")


@query(
    "scale_minmax",
    f"""SELECT event_id, round((value - lo) / (hi - lo), 4) AS scaled
        FROM {GAPPED_EVENTS}, (SELECT min(value) AS lo, max(value) AS hi FROM {GAPPED_EVENTS})
        WHERE value IS NOT NULL""",
)
def scale_minmax(t):
    return cw.scale_minmax(gapped_events(t), "value", "scaled").select("event_id", "scaled")


@query(
    "scale_robust",
    f"""SELECT event_id, round((coalesce(value, 0) - q[2]) / (q[3] - q[1]), 4) AS scaled
        FROM {GAPPED_EVENTS},
             (SELECT quantile_cont(coalesce(value, 0), [0.25, 0.5, 0.75]) AS q FROM {GAPPED_EVENTS})""",
)
def scale_robust(t):
    return cw.scale_robust(gapped_events(t), "value", "scaled").select("event_id", "scaled")


# Binning


@query(
    "bin_labels",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 25 THEN 'medium' ELSE 'large' END AS size_class
       FROM part""",
)
def bin_labels(t):
    df = cw.bin_labels(t.part, "p_size", ["1", "10", "25"], ["9", "24", "50"], ["small", "medium", "large"], "size class")
    return df.select("p_partkey", "size_class")


@query(
    "bin_percent",
    f"""SELECT event_id, CASE WHEN value IS NULL OR value > 400 THEN NULL WHEN value < 100 THEN 'low'
               WHEN value < 250 THEN 'middle' ELSE 'high' END AS class FROM {GAPPED_EVENTS}""",
)
def bin_percent(t):
    df = cw.bin_percent(
        gapped_events(t), "value", [0, 100, 250], [100, 250, 400], ["low", "middle", "high"], "class", on_outside="null"
    )
    return df.select("event_id", "class")


@query(
    "bin_quantile",
    """SELECT l_orderkey, l_linenumber, cast((l_extendedprice >= q[1])::INT + (l_extendedprice >= q[2])::INT
              + (l_extendedprice >= q[3])::INT AS DOUBLE) AS quartile
       FROM lineitem, (SELECT quantile_disc(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem)""",
)
def bin_quantile(t):
    return cw.bin_quantile(t.lineitem, "l_extendedprice", "quartile").select("l_orderkey", "l_linenumber", "quartile")


@query(
    "bin_quantile_ties",
    """SELECT l_orderkey, l_linenumber, cast((l_discount >= q[1])::INT + (l_discount >= q[2])::INT
              + (l_discount >= q[3])::INT AS DOUBLE) AS quartile
       FROM lineitem, (SELECT quantile_disc(l_discount, [0.25, 0.5, 0.75]) AS q FROM lineitem)""",
)
def bin_quantile_ties(t):
    return cw.bin_quantile(t.lineitem, "l_discount", "quartile").select("l_orderkey", "l_linenumber", "quartile")


# Encoding


@query(
    "encode_category",
    """SELECT doc_id, source, dense_rank() OVER (ORDER BY source) AS code FROM documents""",
)
def encode_category(t):
    return cw.encode_category(t.documents, "source", "code").select("doc_id", "source", "code")


@query("encode_category_two", "SELECT doc_id, toxic, dense_rank() OVER (ORDER BY toxic) - 1 AS code FROM labels")
def encode_category_two(t):
    return cw.encode_category(t.labels, "toxic", "code").select("doc_id", "toxic", "code")


@query(
    "encode_category_many",
    """SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_orderkey) AS code
       FROM lineitem""",
)
def encode_category_many(t):
    return cw.encode_category(t.lineitem, "l_orderkey", "code").select("l_orderkey", "l_linenumber", "code")


# Statistics


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) <= count(*) / 10 THEN 'classification'
            ELSE 'continuous' END AS ftype, '{kind}' AS type, {i} AS rank FROM {table}"""
        for i, (c, kind) in enumerate(columns.items())
    )


@query(
    "column_profile",
    _profile_sql(
        "customer",
        {
            "c_custkey": "integer",
            "c_name": "string",
            "c_nationkey": "integer",
            "c_acctbal": "integer",
            "c_mktsegment": "string",
        },
    ),
)
def column_profile(t):
    return cw.column_profile(t.customer)


ORDERS = _profile_sql(
    "orders",
    {
        "o_orderkey": "integer",
        "o_custkey": "integer",
        "o_orderstatus": "string",
        "o_totalprice": "integer",
        "o_orderdate": "string",
        "o_orderpriority": "string",
    },
)
LINEITEM = _profile_sql(
    "lineitem",
    {
        "l_orderkey": "integer",
        "l_partkey": "integer",
        "l_suppkey": "integer",
        "l_linenumber": "integer",
        "l_quantity": "integer",
        "l_extendedprice": "integer",
        "l_discount": "integer",
        "l_tax": "integer",
        "l_returnflag": "string",
        "l_linestatus": "string",
        "l_shipdate": "string",
    },
)


@query("column_profile_approx", ORDERS)
def column_profile_approx(t):
    return cw.column_profile(t.orders, approx=True)


@query("column_profile_orders", ORDERS)
def column_profile_orders(t):
    return cw.column_profile(t.orders)


@query("column_profile_lineitem", LINEITEM)
def column_profile_lineitem(t):
    return cw.column_profile(t.lineitem)


@query("column_profile_lineitem_approx", LINEITEM)
def column_profile_lineitem_approx(t):
    return cw.column_profile(t.lineitem, approx=True)


@query("column_min_max_bigint", "SELECT min(big) AS min, max(big) AS max FROM (SELECT l_orderkey + 9007199254740993 AS big FROM lineitem)")
def column_min_max_bigint(t):
    return cw.column_min_max(t.lineitem.selectExpr("l_orderkey + 9007199254740993 AS big"), "big")


@query(
    "column_min_max",
    """SELECT cast(trunc(min(c_acctbal)) AS BIGINT) AS min, cast(trunc(max(c_acctbal)) AS BIGINT) AS max
       FROM customer""",
)
def column_min_max(t):
    return cw.column_min_max(t.customer, "c_acctbal")


@query("column_mean", f"SELECT round(avg(value), 4) AS mean FROM {GAPPED_EVENTS}")
def column_mean(t):
    return cw.round_column(cw.column_mean(gapped_events(t), "value"), "mean", 4)


@query(
    "column_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean,
            round(stddev_samp({c}), 4) AS stddev, cast(min({c}) AS DOUBLE) AS min, cast(max({c}) AS DOUBLE) AS max
            FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_linenumber")
    ),
)
def column_describe(t):
    df = cw.column_describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_linenumber"])
    return cw.round_column(cw.round_column(df, "mean", 4), "stddev", 4)


@query("distinct_values", "SELECT DISTINCT l_shipdate FROM lineitem")
def distinct_values(t):
    return cw.distinct_values(t.lineitem, "l_shipdate")


@query(
    "distinct_count",
    f"SELECT count(*) AS distinct_count FROM (SELECT DISTINCT value FROM {GAPPED_EVENTS})",
)
def distinct_count(t):
    return cw.distinct_count(gapped_events(t), "value")


@query("row_count", "SELECT count(*) AS rows FROM lineitem")
def row_count(t):
    return cw.row_count(t.lineitem)


@query("table_size", "SELECT count(*) AS rows, 6 AS columns FROM orders")
def table_size(t):
    return cw.table_size(t.orders)
