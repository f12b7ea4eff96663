"""Row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

import colwright as cw
from workload import query

# The tables hold no nulls, so nulls are derived alike on both sides.
GAPPED = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"


def gapped_events(t):
    return t.events.withColumn("value", F.expr(GAPPED))


@query("filter_equal", "SELECT * FROM part WHERE p_size = 15")
def filter_equal(t):
    return cw.filter_equal(t.part, "p_size", "15")


@query("filter_equal_list", "SELECT * FROM events WHERE event_type IN ('click', 'error')")
def filter_equal_list(t):
    return cw.filter_equal(t.events, "event_type", ["click", "error"])


@query("filter_not_equal", f"SELECT event_id, {GAPPED} AS value FROM events WHERE {GAPPED} <> 12.31")
def filter_not_equal(t):
    return cw.filter_not_equal(gapped_events(t), "value", 12.31).select("event_id", "value")


@query("filter_greater", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")
def filter_greater(t):
    return cw.filter_greater(t.lineitem, "l_quantity", "49").select("l_orderkey", "l_quantity")


@query("filter_greater_equal", "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00'")
def filter_greater_equal(t):
    return cw.filter_greater_equal(t.orders, "o_orderdate", "1998-01-01")


@query("filter_less", "SELECT * FROM part WHERE p_size < 2.5")
def filter_less(t):
    return cw.filter_less(t.part, "p_size", 2.5)


@query("filter_less_equal", "SELECT * FROM events WHERE value <= 10.05")
def filter_less_equal(t):
    return cw.filter_less_equal(t.events, "value", 10.05)


@query(
    "filter_between",
    "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.05",
)
def filter_between(t):
    return cw.filter_between(t.lineitem, "l_discount", 0.02, 0.05).select("l_orderkey", "l_linenumber", "l_discount")


@query("filter_null", f"SELECT event_id, {GAPPED} AS value FROM events WHERE {GAPPED} IS NULL")
def filter_null(t):
    return cw.filter_null(gapped_events(t), "value").select("event_id", "value")


@query("filter_not_null", f"SELECT event_id, {GAPPED} AS value FROM events WHERE {GAPPED} IS NOT NULL")
def filter_not_null(t):
    return cw.filter_not_null(gapped_events(t), "value").select("event_id", "value")


@query("filter_contains", "SELECT doc_id, lang FROM documents WHERE text LIKE '%the_%and%'")
def filter_contains(t):
    return cw.filter_contains(t.documents, "text", "the_%and").select("doc_id", "lang")


@query("filter_contains_literal", "SELECT doc_id, lang FROM documents WHERE contains(text, '%')")
def filter_contains_literal(t):
    return cw.filter_contains(t.documents, "text", "%", literal=True).select("doc_id", "lang")


@query("filter_startswith", "SELECT * FROM part WHERE starts_with(p_name, 'red')")
def filter_startswith(t):
    return cw.filter_startswith(t.part, "p_name", "red")


@query("filter_endswith", "SELECT page_id, url FROM pages WHERE suffix(url, '#top')")
def filter_endswith(t):
    return cw.filter_endswith(t.pages, "url", "#top").select("page_id", "url")


@query("delete_negative", "SELECT * FROM customer WHERE c_acctbal >= 0")
def delete_negative(t):
    return cw.delete_negative(t.customer, "c_acctbal")


@query("delete_zero", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount <> 0")
def delete_zero(t):
    return cw.delete_zero(t.lineitem, "l_discount").select("l_orderkey", "l_linenumber", "l_discount")


@query("delete_null", f"SELECT event_id, {GAPPED} AS value FROM events WHERE {GAPPED} IS NOT NULL")
def delete_null(t):
    return cw.delete_null(gapped_events(t), "value").select("event_id", "value")
