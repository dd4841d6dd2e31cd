"""Holds a query's rows against its SQL run by DuckDB on the same tables."""

from __future__ import annotations

import os

import duckdb


def rows_of(values):
    def plain(v):
        if isinstance(v, float):
            return round(v, 5)
        return str(v) if not isinstance(v, (int, bool, str, type(None))) else v

    return sorted((tuple(plain(v) for v in row) for row in values), key=repr)


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    out = con.sql(sql)
    order = sorted(range(len(out.columns)), key=lambda k: out.columns[k])
    return [out.columns[k] for k in order], rows_of(tuple(r[k] for k in order) for r in out.fetchall())


def query_rows(df):
    names = sorted(df.columns)
    return names, rows_of(df.select(*[f"`{n}`" for n in names]).collect())
