"""Compare every query with its DuckDB SQL: ``python tests/oracle_check.py <table folder> [query …]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def _plain(value, digits):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return value if digits is None else round(value, digits)
    return value


def rows_of(columns, rows, digits=None):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i], digits) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in r))


def compare(df, connection, sql: str, digits=None) -> str | None:
    """None when columns, rows and values agree, else what differs."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = rows_of(names, cursor.fetchall(), digits)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()], digits)
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    for a, b in zip(got, expected):
        if a != b:
            return f"{a} against {b}"
    declared = {d[0]: str(d[1]) for d in cursor.description}
    wrong = {c: (t, declared[c]) for c, t in df.dtypes if SQL_TYPES[t] != declared[c]}
    return f"types {wrong}" if wrong else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder, *names = sys.argv[1:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles = connect(folder), entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            problem = compare(df, connection, oracles[name]) if name in oracles else f"rows only: {df.count()}"
        except Exception as error:
            problem = f"{type(error).__name__} {str(error)[:300]}"
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - start:.1f}s {problem or ''}"[:700], flush=True)
