"""Runs a registered query against its SQL and compares the rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(path: str):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    return con


def _value(x):
    if isinstance(x, float):
        return int(x) if x == int(x) and not math.isinf(x) else round(x, 9)
    return bool(x) if str(type(x)).find("bool") >= 0 else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in data), key=repr)


def check(spark, con, path, query, sql):
    """Fails on a difference; returns the number of rows."""
    want = con.sql(sql)
    got = query(spark, path)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, got.collect()), rows(want.columns, want.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b):
        assert x == y, (x, y)
    return len(a)
