"""Holds a query's rows against its SQL."""

import os

import duckdb


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(r)) for r in df.select(*(df[n] for n in names)).collect())


def rows_of_sql(sql, sf_dir):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    made = c.sql(sql)
    names = sorted(made.columns)
    places = [made.columns.index(n) for n in names]
    return names, sorted(repr(tuple(r[p] for p in places)) for r in made.fetchall())
