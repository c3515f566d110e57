"""Runs a query and its SQL over the same tables and compares the rows."""

import os
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 6) + 0.0
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return round(float(v), 6) + 0.0 if isinstance(v, (int, np.integer, Decimal)) else v


def frame_rows(df):
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))


def sql_frame(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).to_arrow_table().to_pandas()


def assert_same(df, sf_dir, sql):
    ours, theirs = df.toPandas(), sql_frame(sf_dir, sql)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    assert frame_rows(ours) == frame_rows(theirs)
