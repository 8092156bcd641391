"""Compare a Spark result with a DuckDB result, order-insensitively."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return f"{value + 0.0:.6f}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def _lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_cell(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql, show: int = 4) -> list[str]:
    """Empty when both results hold the same columns and rows."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(spark_df.columns) != sorted(columns):
        return [f"columns {sorted(spark_df.columns)} != {sorted(columns)}"]
    actual = [tuple(row) for row in spark_df.collect()]
    mine, theirs = _lines(spark_df.columns, actual), _lines(columns, expected)
    if mine == theirs:
        return []
    return (
        [f"rows {len(mine)} != {len(theirs)}"]
        + [f"spark {x}" for x in sorted(set(mine) - set(theirs))[:show]]
        + [f"duck  {x}" for x in sorted(set(theirs) - set(mine))[:show]]
    )
