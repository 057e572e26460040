"""Spark rows against DuckDB rows, compared as sorted lists of text."""

from __future__ import annotations

import os

import duckdb


def rows_of(frame) -> list[tuple]:
    def cell(x):
        if x is None or x != x:
            return "null"
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(x)

    return sorted(tuple(cell(x) for x in row) for row in frame)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = os.path.join(sf_dir, name)
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def assert_same(df, con, sql: str) -> None:
    columns = sorted(df.columns)
    got = rows_of(df.select(*columns).toPandas().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None))
    expected = con.sql(sql)
    assert sorted(expected.columns) == columns
    want = rows_of(expected.select(*[f'"{c}"' for c in columns]).df().astype(object).where(lambda x: x.notna(), None).itertuples(index=False, name=None))
    assert got == want
