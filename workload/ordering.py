"""Sorting, rows per group, de-duplication and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

import colwright as cw
from workload import query
from workload.filters import GAPPED, gapped_events


@query("sort_asc", "SELECT * FROM orders ORDER BY o_totalprice NULLS FIRST")
def sort_asc(t):
    return cw.sort_asc(t.orders, "o_totalprice")


@query("sort_desc", f"SELECT event_id, {GAPPED} AS value FROM events ORDER BY value DESC NULLS LAST")
def sort_desc(t):
    return cw.sort_desc(gapped_events(t), "value").select("event_id", "value")


@query(
    "sort_by_date",
    "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS o_orderdate FROM orders ORDER BY orders.o_orderdate",
)
def sort_by_date(t):
    text = cw.change_date_format(t.orders, "o_orderdate", "dd/MM/yyyy")
    return cw.sort_by_date(text, "o_orderdate", "%d.%m.%Y", read_as="dd/MM/yyyy").select("o_orderkey", "o_orderdate")


PICK = """SELECT * FROM (SELECT {columns}, cast(rank() OVER (PARTITION BY {group} ORDER BY {order}) AS INTEGER) AS rank
          FROM {table}) WHERE rank <= {n}"""


@query(
    "pick_first_n",
    PICK.format(
        columns="o_orderkey, o_custkey, o_totalprice",
        group="o_custkey",
        order="o_totalprice DESC NULLS LAST",
        table="orders",
        n=3,
    ),
)
def pick_first_n(t):
    df = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return cw.pick_first_n(df, "o_custkey", "o_totalprice", "3")


@query(
    "pick_last_n",
    PICK.format(
        columns="event_id, user_id, value",
        group="user_id",
        order="value ASC NULLS FIRST",
        table=f"(SELECT event_id, user_id, {GAPPED} AS value FROM events)",
        n=15,
    ),
)
def pick_last_n(t):
    return cw.pick_last_n(gapped_events(t).select("event_id", "user_id", "value"), "user_id", "value", 15)


TIES = PICK.format(
    columns="l_orderkey, l_linenumber, l_returnflag, l_quantity",
    group="l_returnflag",
    order="l_quantity {way}",
    table="lineitem",
    n="{n}",
)


@query("pick_first_n_ties", TIES.format(way="DESC NULLS LAST", n=500))
def pick_first_n_ties(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return cw.pick_first_n(df, "l_returnflag", "l_quantity", 500)


@query("pick_last_n_many", TIES.format(way="ASC NULLS FIRST", n=5000))
def pick_last_n_many(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return cw.pick_last_n(df, "l_returnflag", "l_quantity", 5000)


@query(
    "deduplicate",
    """SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place
       FROM orders) WHERE place = 1""",
)
def deduplicate(t):
    return cw.deduplicate(t.orders, "o_custkey", order_by="o_orderkey")


@query(
    "deduplicate_any",
    """SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY user_id
           ORDER BY event_id, ts, event_type, value, props) AS place FROM events) WHERE place = 1""",
)
def deduplicate_any(t):
    return cw.deduplicate(t.events, "user_id")


# Joins. Neither of the two tables covers the keys of the other.

LEFT = "(SELECT doc_id, quality, toxic FROM labels)"
RIGHT = "(SELECT conv_id, turn, role FROM conversations)"
BOTH = "{key} AS doc_id, quality, toxic, turn, role"

JOINS = {
    "inner": f"SELECT {BOTH.format(key='doc_id')} FROM {LEFT} JOIN {RIGHT} ON doc_id = conv_id",
    "left": f"SELECT {BOTH.format(key='doc_id')} FROM {LEFT} LEFT JOIN {RIGHT} ON doc_id = conv_id",
    "right": f"SELECT {BOTH.format(key='conv_id')} FROM {LEFT} RIGHT JOIN {RIGHT} ON doc_id = conv_id",
    "full": f"SELECT {BOTH.format(key='coalesce(doc_id, conv_id)')} FROM {LEFT} FULL JOIN {RIGHT} ON doc_id = conv_id",
    "semi": f"SELECT * FROM {LEFT} SEMI JOIN {RIGHT} ON doc_id = conv_id",
    "anti": f"SELECT * FROM {LEFT} ANTI JOIN {RIGHT} ON doc_id = conv_id",
}


# Fewer rows per key and task than a conversation has turns.
SPLIT_ROWS = 3


def _join(key: str, how: str, sql: str, **options) -> None:
    @query(key, sql)
    def build(t):
        right = t.conversations.select("conv_id", "turn", "role")
        return cw.join_tables(t.labels, right, ["doc_id"], ["conv_id"], how, **options)


for _how, _sql in JOINS.items():
    _join(f"join_{_how}", _how, _sql)
    # The same on the grid of hot keys, which tables of this size do not need.
    _join(f"join_{_how}_split", _how, _sql, split_hot_keys=True, part_rows=SPLIT_ROWS)


@query(
    "join_two_keys",
    """SELECT l_partkey, l_suppkey, a.n AS n, b.quantity AS quantity
       FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) a
       JOIN (SELECT l_partkey AS p, l_suppkey AS s, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL) b
         ON l_partkey = p AND l_suppkey = s""",
)
def join_two_keys(t):
    counts = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    sums = t.lineitem.groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    sums = sums.agg(F.sum("l_quantity").alias("quantity"))
    return cw.join_tables(counts, sums, ["l_partkey", "l_suppkey"], ["p", "s"])
