"""Runs a query and its SQL on the same tables."""

import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def connection(sf_dir: str = SMALL):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=lambda r: tuple(map(str, r)))


def assert_same(df, con, sql):
    got = df.collect()
    want = con.execute(sql)
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, got) == rows(cols, want.fetchall())
