"""Side-by-side comparison of a Spark query with SQL over the same tables."""

import glob
import os

import numpy as np
import pandas as pd


def connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, (np.ndarray, list)):
        return [plain(x) for x in v]
    if v is None or v is pd.NA or isinstance(v, (float, np.floating)) and np.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.number)):
        return round(float(v), 9)
    return v


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


def same(spark_df, con, sql):
    mine, theirs = spark_df.toPandas(), con.execute(sql).fetch_df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = rows(mine), rows(theirs)
    assert len(a) == len(b)
    assert a == b
