"""Runs a query and its SQL over the same folder and compares all rows."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb

SMALL = "/root/testdata/sf0.001"


def connect(folder: str = SMALL) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    key = lambda row: tuple((v is None, str(type(v)), str(v)) for v in row)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    at = [found.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=key)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == b
