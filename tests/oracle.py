"""Comparison of a query with its SQL on DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    text = lambda v: None if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    for c in frame.columns:
        frame[c] = frame[c].map(text).astype(object)
    return frame.sort_values(list(frame.columns), na_position="last").reset_index(drop=True)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False)
