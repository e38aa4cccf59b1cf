"""Comparison of a query's rows with those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return repr(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in found)


def connection():
    c = duckdb.connect()
    for p in Path(DATA).iterdir():
        c.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}'")
    return c


def same(spark, query, sql):
    df = query(spark, DATA)
    cursor = connection().execute(sql)
    expected = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert rows(df.columns, df.collect()) == expected
