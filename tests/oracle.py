"""Spark result against DuckDB's over the same Parquet tables."""

import glob
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def database(sf_dir=SF):
    db = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{at}'")
    return db


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(v, 6) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in data), key=repr)


def assert_same(df, sql, sf_dir=SF):
    got = database(sf_dir).execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, got.fetchall())
