"""Sources, sinks, previews and changes of table structure."""

from __future__ import annotations

from pyspark.sql import functions as F

import colwright as cw
from colwright.sources.shared import shared_path
from workload import query


@query(
    "read_csv",
    """SELECT cast(c_custkey AS INTEGER) AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
       FROM customer""",
)
def read_csv(t):
    path = shared_path(t.spark, "customer-csv")
    t.customer.write.option("header", True).csv(path)
    return cw.read_csv(t.spark, path)


@query("read_csv_with_schema", "SELECT * FROM part")
def read_csv_with_schema(t):
    path = shared_path(t.spark, "part-csv")
    part = t.part
    part.write.option("header", True).csv(path)
    return cw.read_csv(t.spark, path, part.schema)


@query("read_csv_multiline", "SELECT * FROM documents")
def read_csv_multiline(t):
    path = shared_path(t.spark, "documents-csv")
    documents = t.documents
    documents.write.option("header", True).option("escape", '"').csv(path)
    return cw.read_csv(t.spark, path, documents.schema, multiLine=True, escape='"')


@query("read_parquet", "SELECT * FROM supplier")
def read_parquet(t):
    return cw.read_parquet(t.spark, f"{t.folder}/supplier.parquet")


@query("save_table", "SELECT * FROM orders")
def save_table(t):
    path = shared_path(t.spark, "orders")
    cw.save_table(t.orders, path, partition_by=["o_orderstatus"])
    return cw.read_parquet(t.spark, path)


@query("save_table_in_place", "SELECT * REPLACE (lower(o_orderstatus) AS o_orderstatus) FROM orders WHERE o_totalprice > 1000")
def save_table_in_place(t):
    # As a stored table is changed step by step: read, changed and saved again under its name.
    path = shared_path(t.spark, "orders")
    cw.save_table(t.orders, path)
    cw.save_table(cw.lower(cw.read_parquet(t.spark, path), "o_orderstatus"), path)
    cw.save_table(cw.filter_greater(cw.read_parquet(t.spark, path), "o_totalprice", 1000), path)
    return cw.read_parquet(t.spark, path)


@query(
    "preview",
    """SELECT cast(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey,
                            'c_acctbal': c_acctbal, 'c_mktsegment': c_mktsegment}) AS VARCHAR) AS "row"
       FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 1000)""",
)
def preview(t):
    return cw.preview(cw.sort_asc(t.customer, "c_custkey"))


@query(
    "preview_random",
    """SELECT least(count(*), 1000) AS n, least(count(*), 1000) AS n_distinct, least(count(*), 1000) AS n_known
       FROM orders""",
)
def preview_random(t):
    # Which rows come out is chance; that they are 1,000 different rows of the table is not.
    drawn = cw.preview_random(t.orders).select(F.get_json_object("row", "$.o_orderkey").cast("bigint").alias("k"))
    known = t.orders.select("o_orderkey").withColumn("known", F.lit(1))
    both = drawn.join(known, drawn.k == known.o_orderkey, "left")
    return both.agg(
        F.count("*").alias("n"), F.count_distinct("k").alias("n_distinct"), F.count("known").alias("n_known")
    )


@query("drop_column", "SELECT * EXCLUDE (l_tax) FROM lineitem")
def drop_column(t):
    return cw.drop_column(t.lineitem, "l_tax")


@query("drop_columns", "SELECT * EXCLUDE (l_tax, l_discount, l_shipdate) FROM lineitem")
def drop_columns(t):
    return cw.drop_columns(t.lineitem, ["l_tax", "l_discount", "l_shipdate"])


@query("rename_column", "SELECT o_orderkey, o_totalprice AS total_price FROM orders")
def rename_column(t):
    return cw.rename_column(t.orders, "o_totalprice", "total price").select("o_orderkey", "total_price")


@query("to_string", "SELECT event_id, cast(value AS VARCHAR) AS value FROM events")
def to_string(t):
    return cw.to_string(t.events, "value").select("event_id", "value")


@query("to_integer", "SELECT c_custkey, cast(trunc(c_acctbal) AS INTEGER) AS c_acctbal FROM customer")
def to_integer(t):
    return cw.to_integer(t.customer, "c_acctbal").select("c_custkey", "c_acctbal")


@query(
    "to_integer_text",
    """SELECT event_id, try_cast(regexp_replace(props, '[^0-9]', '', 'g') AS INTEGER) AS props,
              try_cast(event_type AS INTEGER) AS event_type FROM events""",
)
def to_integer_text(t):
    digits = cw.replace_text(t.events, "props", "[^0-9]", "")
    both = cw.to_integer(cw.to_integer(digits, "props"), "event_type")
    return both.select("event_id", "props", "event_type")


@query(
    "concat_columns",
    """SELECT event_id, cast(user_id AS VARCHAR) || event_type ||
              CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS joined FROM events""",
)
def concat_columns(t):
    events = t.events.withColumn("props", F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END"))
    return cw.concat_columns(events, ["user_id", "event_type", "props"], "joined").select("event_id", "joined")


@query(
    "merge_columns",
    """SELECT event_id, cast(user_id AS VARCHAR) || '; ' || event_type || '; ' ||
              CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS joined FROM events""",
)
def merge_columns(t):
    events = t.events.withColumn("props", F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END"))
    return cw.merge_columns(events, ["user_id", "event_type", "props"], "joined", "; ").select("event_id", "joined")


@query(
    "split_column",
    """SELECT p_partkey, p_name, string_split_regex(p_name, ' ')[1] AS column_0,
              string_split_regex(p_name, ' ')[2] AS column_1 FROM part""",
)
def split_column(t):
    return cw.split_column(t.part.select("p_partkey", "p_name"), "p_name", " ")


@query(
    "split_column_n",
    """SELECT page_id, string_split_regex(url, '[/?#]')[1] AS piece_0, string_split_regex(url, '[/?#]')[2] AS piece_1,
              string_split_regex(url, '[/?#]')[3] AS piece_2, string_split_regex(url, '[/?#]')[4] AS piece_3,
              string_split_regex(url, '[/?#]')[5] AS piece_4, string_split_regex(url, '[/?#]')[6] AS piece_5,
              string_split_regex(url, '[/?#]')[7] AS piece_6, string_split_regex(url, '[/?#]')[8] AS piece_7
       FROM pages""",
)
def split_column_n(t):
    pages = t.pages.select("page_id", "url")
    return cw.drop_column(cw.split_column(pages, "url", "[/?#]", n=8, prefix="piece_"), "url")


@query(
    "max_split_size",
    "SELECT cast(max(len(string_split_regex(url, '[/?#]'))) AS INTEGER) AS max_size FROM pages",
)
def max_split_size(t):
    return cw.max_split_size(t.pages, "url", "[/?#]")


@query("new_column_name", "SELECT c_custkey, upper(c_name) AS name_in_capitals FROM customer")
def new_column_name(t):
    return cw.upper_new(t.customer, "c_name", "name in capitals").select("c_custkey", "name_in_capitals")


@query(
    "insert_after",
    """SELECT p_partkey, p_name, p_brand, upper(p_brand) AS brand, p_type, p_size, p_retailprice,
              4 AS brand_position FROM part""",
)
def insert_after(t):
    placed = cw.upper_new(t.part, "p_brand", "brand", after="p_brand")
    return placed.withColumn("brand_position", F.lit(placed.columns.index("brand") + 1))


@query(
    "column_metadata",
    """SELECT i AS "index", label, type, (SELECT count(*) FROM part) AS "rows"
       FROM (VALUES (0, 'p_partkey', 'integer'), (1, 'brand', 'string'), (2, 'p_type', 'string'),
                    (3, 'p_size', 'integer'), (4, 'p_retailprice', 'string'),
                    (5, 'column_0', 'string'), (6, 'column_1', 'string')) m(i, label, type)""",
)
def column_metadata(t):
    # The description of a table after a few changes of structure, with its row count.
    changed = cw.rename_column(cw.to_string(t.part, "p_retailprice"), "p_brand", "brand")
    changed = cw.drop_column(cw.split_column(changed, "p_name", " "), "p_name")
    rows = cw.row_count(changed).scalar()
    return cw.column_metadata(changed).withColumn("rows", rows)
