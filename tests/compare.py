"""Run a registered query and its SQL on the same tables and compare every value."""

import glob
import math
import os
from decimal import Decimal

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, Decimal):
        return float(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, db, query, sql, sf_dir):
    """None when both agree, else a text saying how they differ."""
    result = query(spark, sf_dir)
    found = _rows(result.columns, [tuple(row) for row in result.collect()])
    relation = db.execute(sql)
    names = [d[0] for d in relation.description]
    expected = _rows(names, relation.fetchall())
    if sorted(result.columns) != sorted(names):
        return f"columns {sorted(result.columns)} against {sorted(names)}"
    if len(found) != len(expected):
        return f"{len(found)} rows against {len(expected)}"
    for mine, theirs in zip(found, expected):
        if mine != theirs:
            return f"{sorted(names)}: {mine} against {theirs}"
    return None if found else "no rows"
