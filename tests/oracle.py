"""Comparing a query's rows with those of its SQL."""

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet({[path] if os.path.isfile(path) else sorted(glob.glob(path + '/*.parquet'))})")
    return con


def plain(value):
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


def assert_same(spark_df, con, sql):
    ours, theirs = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
