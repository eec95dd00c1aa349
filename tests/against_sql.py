"""Runs a query and its SQL over the same tables and compares the rows."""

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def database(sf_dir=SF):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        path = f"{sf_dir}/{file}"
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows_of(df):
    def text(v):
        if isinstance(v, list | tuple):
            return str(v)
        if pd.isna(v):
            return ""
        return f"{float(v):.6g}" if isinstance(v, float) or hasattr(v, "as_tuple") else str(v)

    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def check(spark, query, sql, con):
    got, want = query(spark, SF).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
