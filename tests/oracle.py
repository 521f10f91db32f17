"""Rows of a query and of its SQL, made comparable."""

import os

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(df):
    """Columns by name, everything as text, rows in order."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None else str(list(v)) if isinstance(v, (list, tuple, np.ndarray)) else str(v))
        elif df[c].dtype.kind == "f":
            df[c] = df[c].round(5)
        elif df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]").astype(str)
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)
