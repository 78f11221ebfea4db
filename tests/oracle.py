"""Comparison of a query with its SQL in DuckDB."""

import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())


def sql_rows(sql, sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    return names, sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def agrees(spark, query, sql, sf_dir):
    got, want = rows_of(query(spark, sf_dir)), sql_rows(sql, sf_dir)
    assert got[0] == want[0]
    assert got[1] == want[1]
