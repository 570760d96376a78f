"""Row-for-row comparison of a query with its DuckDB SQL."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        path = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{path}'")
    return con


def rows(pdf):
    def value(v):
        if v is None or v is pd.NA or v != v:
            return ""
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.number)):
            return f"{round(float(v), 5) + 0.0:.5f}"
        return str(v)

    return sorted(tuple(map(value, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


def check(spark, con, sf_dir, name, query, sql):
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns), name
    assert rows(got) == rows(want), name
