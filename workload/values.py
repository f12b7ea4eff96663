"""Text, arithmetic, date and constant-replacement operators: one row in, one row out."""

from __future__ import annotations

from pyspark.sql import functions as F

import colwright as cw
from workload import query
from workload.filters import GAPPED, gapped_events


# Text


@query("upper", "SELECT conv_id, turn, upper(role) AS role FROM conversations")
def upper(t):
    return cw.upper(t.conversations, "role").select("conv_id", "turn", "role")


@query("upper_new", "SELECT p_partkey, p_name, upper(p_name) AS capitals FROM part")
def upper_new(t):
    return cw.upper_new(t.part, "p_name", "capitals").select("p_partkey", "p_name", "capitals")


@query("lower", "SELECT doc_id, lower(text) AS text FROM documents")
def lower(t):
    return cw.lower(t.documents, "text").select("doc_id", "text")


@query("lower_new", "SELECT c_custkey, c_mktsegment, lower(c_mktsegment) AS segment FROM customer")
def lower_new(t):
    return cw.lower_new(t.customer, "c_mktsegment", "segment").select("c_custkey", "c_mktsegment", "segment")


@query(
    "initcap",
    """SELECT o_orderkey, array_to_string(list_transform(string_split(o_orderpriority, ' '),
              lambda w: upper(w[1]) || lower(w[2:])), ' ') AS o_orderpriority FROM orders""",
)
def initcap(t):
    return cw.initcap(t.orders, "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query(
    "initcap_new",
    """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
              lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM part""",
)
def initcap_new(t):
    return cw.initcap(t.part, "p_name", "title").select("p_partkey", "title")


@query("trim", "SELECT p_partkey, trim('  ' || p_name || ' ') AS padded FROM part")
def trim(t):
    padded = t.part.select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("padded"))
    return cw.trim(padded, "padded")


@query("substring_new", "SELECT c_custkey, substring(c_name, 10, 9) AS number FROM customer")
def substring_new(t):
    return cw.substring_new(t.customer, "c_name", "10", "9", "number").select("c_custkey", "number")


@query("replace_text", "SELECT doc_id, regexp_replace(text, '[aeiou]+', '*', 'g') AS text FROM documents")
def replace_text(t):
    return cw.replace_text(t.documents, "text", "[aeiou]+", "*").select("doc_id", "text")


@query(
    "replace_text_new",
    "SELECT page_id, regexp_replace(url, '^(https?)://([^/]+).*$', '\\2 over \\1', 'g') AS site FROM pages",
)
def replace_text_new(t):
    return cw.replace_text_new(t.pages, "url", "^(https?)://([^/]+).*$", "$2 over $1", "site").select("page_id", "site")


# Arithmetic


@query(
    "sum_columns",
    "SELECT l_orderkey, l_linenumber, l_extendedprice + l_quantity + l_tax AS result FROM lineitem",
)
def sum_columns(t):
    df = cw.sum_columns(t.lineitem, ["l_extendedprice", "l_quantity", "l_tax"], "result")
    return df.select("l_orderkey", "l_linenumber", "result")


@query(
    "sub_columns",
    "SELECT l_orderkey, l_linenumber, l_extendedprice - l_quantity - l_tax AS result FROM lineitem",
)
def sub_columns(t):
    df = cw.sub_columns(t.lineitem, ["l_extendedprice", "l_quantity", "l_tax"], "result")
    return df.select("l_orderkey", "l_linenumber", "result")


@query("mul_columns", f"SELECT event_id, event_id * ({GAPPED}) AS result FROM events")
def mul_columns(t):
    return cw.mul_columns(gapped_events(t), ["event_id", "value"], "result").select("event_id", "result")


@query(
    "div_columns",
    "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) / nullif(l_tax, 0) AS result FROM lineitem",
)
def div_columns(t):
    df = cw.div_columns(t.lineitem, ["l_extendedprice", "l_discount", "l_tax"], "result")
    return df.select("l_orderkey", "l_linenumber", "result")


@query(
    "log_new",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 4) END AS result FROM customer",
)
def log_new(t):
    return cw.log_new(t.customer, "c_acctbal", "result").select("c_custkey", "result")


@query(
    "scale_log",
    f"SELECT event_id, CASE WHEN {GAPPED} > 0 THEN round(ln({GAPPED}), 4) END AS result FROM events",
)
def scale_log(t):
    return cw.scale_log(gapped_events(t), "value", "result").select("event_id", "result")


@query("round_column", "SELECT c_custkey, round(c_acctbal, 1) AS c_acctbal FROM customer")
def round_column(t):
    return cw.round_column(t.customer, "c_acctbal", 1).select("c_custkey", "c_acctbal")


@query("abs_new", "SELECT c_custkey, abs(c_acctbal) AS result FROM customer")
def abs_new(t):
    return cw.abs_new(t.customer, "c_acctbal", "result").select("c_custkey", "result")


@query("sqrt_new", "SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 4) AS result FROM lineitem")
def sqrt_new(t):
    return cw.sqrt_new(t.lineitem, "l_extendedprice", "result").select("l_orderkey", "l_linenumber", "result")


@query("square_new", "SELECT c_custkey, c_acctbal * c_acctbal AS result FROM customer")
def square_new(t):
    return cw.square_new(t.customer, "c_acctbal", "result").select("c_custkey", "result")


@query("ceil_new", "SELECT c_custkey, cast(ceil(c_acctbal) AS BIGINT) AS result FROM customer")
def ceil_new(t):
    return cw.ceil_new(t.customer, "c_acctbal", "result").select("c_custkey", "result")


@query("floor_new", "SELECT c_custkey, cast(floor(c_acctbal) AS BIGINT) AS result FROM customer")
def floor_new(t):
    return cw.floor_new(t.customer, "c_acctbal", "result").select("c_custkey", "result")


# Dates


def _part(key: str, sql: str) -> None:
    extract = getattr(cw, key)

    @query(key, f"SELECT event_id, cast({sql} AS INTEGER) AS part FROM events")
    def build(t):
        return extract(t.events, "ts", "part").select("event_id", "part")


_part("extract_year", "year(ts)")
_part("extract_month", "month(ts)")
_part("extract_day", "day(ts)")
_part("extract_hour", "hour(ts)")
_part("extract_minute", "minute(ts)")
_part("extract_second", "second(ts)")
_part("extract_day_of_week", "dayofweek(ts) + 1")


@query(
    "date_diff",
    """SELECT l_orderkey, l_linenumber,
              cast(date_diff('day', cast(o_orderdate AS DATE), cast(l_shipdate AS DATE)) AS INTEGER) AS days
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def date_diff(t):
    df = cw.join_tables(t.lineitem, t.orders, "l_orderkey", "o_orderkey")
    return cw.date_diff(df, "l_shipdate", "o_orderdate", "days").select("l_orderkey", "l_linenumber", "days")


@query(
    "is_weekday",
    """SELECT event_id, coalesce(isodow(CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END) <= 5, false) AS working
       FROM events""",
)
def is_weekday(t):
    events = t.events.withColumn("ts", F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END"))
    return cw.is_weekday(events, "ts", "working").select("event_id", "working")


@query(
    "is_leap_year",
    """SELECT o_orderkey, y AS "year", (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 AS leap
       FROM (SELECT o_orderkey, cast(year(o_orderdate) AS INTEGER) AS y FROM orders)""",
)
def is_leap_year(t):
    years = cw.extract_year(t.orders, "o_orderdate", "year")
    return cw.is_leap_year(years, "year", "leap").select("o_orderkey", "year", "leap")


@query("change_date_format", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS o_orderdate FROM orders")
def change_date_format(t):
    return cw.change_date_format(t.orders, "o_orderdate", "%d/%m/%Y").select("o_orderkey", "o_orderdate")


@query(
    "change_date_format_text",
    "SELECT event_id, strftime(ts, '%Y.%m.%d at %H:%M') AS ts FROM events",
)
def change_date_format_text(t):
    text = cw.change_date_format(t.events, "ts", "dd-MM-yyyy HH:mm")
    return cw.change_date_format(text, "ts", "%Y.%m.%d at %H:%M", read_as="dd-MM-yyyy HH:mm").select("event_id", "ts")


@query("parse_date", "SELECT o_orderkey, cast(o_orderdate AS DATE) AS o_orderdate FROM orders")
def parse_date(t):
    text = cw.change_date_format(t.orders, "o_orderdate", "dd/MM/yyyy")
    return cw.parse_date(text, "o_orderdate", "dd/MM/yyyy").select("o_orderkey", "o_orderdate")


# Replacement by constants


@query("replace_null_const", f"SELECT event_id, coalesce({GAPPED}, 7.5) AS value FROM events")
def replace_null_const(t):
    return cw.replace_null_const(gapped_events(t), "value", "7.5").select("event_id", "value")


@query(
    "replace_negative_const",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer",
)
def replace_negative_const(t):
    return cw.replace_negative_const(t.customer, "c_acctbal", 0).select("c_custkey", "c_acctbal")


@query(
    "replace_zero_const",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0.01 ELSE l_discount END AS l_discount
       FROM lineitem""",
)
def replace_zero_const(t):
    df = cw.replace_zero_const(t.lineitem, "l_discount", 0.01)
    return df.select("l_orderkey", "l_linenumber", "l_discount")


@query("replace_value", "SELECT p_partkey, CASE WHEN p_size = 15 THEN -1 ELSE p_size END AS size FROM part")
def replace_value(t):
    return cw.replace_value(t.part, "p_size", "15", "-1", "size").select("p_partkey", "size")


@query("replace_value_null", f"SELECT event_id, coalesce({GAPPED}, -1) AS filled FROM events")
def replace_value_null(t):
    return cw.replace_value(gapped_events(t), "value", "null", -1, "filled").select("event_id", "filled")
