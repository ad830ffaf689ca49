"""Rows of a query and of its SQL, in comparable form."""

import math


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def table(rows, columns):
    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


def duck(sf):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    return con


def same(spark, con, sf, query, sql):
    df = query(spark, sf)
    columns = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    assert table([r.asDict() for r in df.collect()], columns) == table([dict(zip(rel.columns, r)) for r in rel.fetchall()], columns)
