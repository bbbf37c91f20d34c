"""Compares queries with their SQL, as the values of sorted rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else f"{float(x):.6g}"
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x).removesuffix(" 00:00:00")
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "float": "FLOAT"}


def difference(spark, con, query, sql, sf_dir) -> str:
    """What differs, in words; empty if nothing does."""
    df = query(spark, sf_dir)
    names, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    kinds = dict((d[0], str(d[1])) for d in found.description)
    other, theirs = rows_of([d[0] for d in found.description], found.fetchall())
    if names != other:
        return f"columns {names} and {other}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows; first: {mine[:1]} {theirs[:1]}"
    for a, b in zip(mine, theirs):
        if a != b:
            return "values " + "; ".join(f"{n}: {x!r} | {y!r}" for n, x, y in zip(names, a, b) if x != y)[:600] + f" in {a[:2]}"
    odd = [f"{n} {k} {kinds[n]}" for n, k in df.dtypes if KINDS.get(k) not in (kinds[n], None) or k not in KINDS]
    return ("types " + ", ".join(odd)) if odd else ""
