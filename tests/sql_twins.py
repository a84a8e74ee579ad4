"""Runs queries beside their SQL twins on the smallest test tables."""

import glob
import os

import duckdb

import compare

SF = os.environ.get("ORDERLOOM_TESTDATA", "/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW \"{os.path.basename(p)[:-8]}\" AS SELECT * FROM '{p}'")
    return con


def check(spark, con, query, sql):
    got, want = query(spark, SF).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.normal(got) == compare.normal(want)
