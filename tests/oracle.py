"""Comparison of a registered query with its SQL in DuckDB."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}{'/*' if os.path.isdir(f) else ''}')")
    return con


def shown(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, con, sql):
    got = con.execute(sql)
    want = shown([c[0] for c in got.description], got.fetchall())
    assert shown(df.columns, [tuple(r) for r in df.collect()]) == want
