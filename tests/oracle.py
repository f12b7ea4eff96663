"""Comparison of a registered query with its SQL: column names, types, row count and exact values."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs; empty if nothing does."""
    theirs = con.execute(sql)
    names = [d[0] for d in theirs.description]
    rows = theirs.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    found = []
    kinds = dict(con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {sql})").fetchall())
    for field in df.schema.fields:
        if SAME_TYPE.get(field.dataType.simpleString()) != kinds[field.name]:
            found.append(f"type of {field.name}: {field.dataType.simpleString()} against {kinds[field.name]}")
    order = sorted(names)
    ours = Counter(tuple(row[c] for c in order) for row in df.collect())
    at = [names.index(c) for c in order]
    wanted = Counter(tuple(row[i] for i in at) for row in rows)
    if sum(ours.values()) != sum(wanted.values()):
        found.append(f"{sum(ours.values())} rows against {sum(wanted.values())}")
    if ours != wanted:
        found.append(f"only in Spark: {list((ours - wanted).items())[:3]}; only in SQL: {list((wanted - ours).items())[:3]}")
    if not wanted:
        found.append("no rows at all: the query shows nothing")
    return found


SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}
