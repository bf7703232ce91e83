"""Rows of a Spark query against those of a DuckDB query."""

import datetime
import decimal
import math
import os

import duckdb


def database(folder):
    db = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{files}')")
    return db


def shown(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def assert_same(df, db, sql):
    names = sorted(df.columns)
    result = db.execute(sql)
    found = [c[0] for c in result.description]
    assert sorted(found) == names
    place = [found.index(n) for n in names]
    left = sorted(tuple(map(shown, r)) for r in df.select(*names).collect())
    right = sorted(tuple(shown(r[i]) for i in place) for r in result.fetchall())
    assert left == right
