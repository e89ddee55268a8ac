"""Run registered queries on Spark and their SQL on DuckDB, and compare whole results."""

import datetime
import glob
import math
import os

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(plain(row[i]) for i in order)) for row in rows))


def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(con, frame, sql):
    """Returns None when equal, else a description of the difference."""
    got = canon(frame.columns, [tuple(r) for r in frame.collect()])
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    types = {d[0]: str(d[1]) for d in answer.description}
    want = canon(columns, answer.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(columns)}"
    if got != want:
        extra = sorted(set(got) - set(want))[:3]
        missing = sorted(set(want) - set(got))[:3]
        return f"{len(got)} rows against {len(want)}; only spark: {extra}; only sql: {missing}"
    odd = {n: (t, types[n]) for n, t in frame.dtypes if KINDS.get(t, t) not in types[n].upper()}
    return f"types {odd}" if odd else None
