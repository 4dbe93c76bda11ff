"""Runs a query and its SQL over the same tables and compares sorted rows."""

import glob
import math
import os

import duckdb
import pandas as pd


def same_rows(spark, sf_dir, query, sql, digits=9):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.sql(sql).df()
    got = query(spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)

    def rows(df):
        def cell(x):
            if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
                return None
            return float(f"{x:.{digits}g}") if isinstance(x, float) else x if isinstance(x, (int, str, bool)) else str(x)

        return sorted((tuple(cell(x) for x in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)

    a, b = rows(want), rows(got)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y
