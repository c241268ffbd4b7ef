"""Runs a named query and its SQL on the same small tables and compares the rows."""

import datetime
import decimal
import math
import os

import duckdb

DATA = os.environ.get("SYMWEAVE_TESTDATA", "/root/testdata/sf0.001")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v if isinstance(v, bool) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in data), key=str)


def check(spark, query, sql):
    out = query(spark, DATA)
    got = out.collect()
    if sql is None:
        return
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(out.columns)
    assert rows(out.columns, got) == rows(columns, found.fetchall())
