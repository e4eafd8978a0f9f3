"""Row comparison between Spark and DuckDB."""

import math
import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def assert_equal(df, con, sql):
    there = con.sql(sql)
    assert sorted(df.columns) == sorted(there.columns)
    assert rows(df.columns, df.collect()) == rows(there.columns, there.fetchall())
