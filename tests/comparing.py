"""Running the DuckDB side and comparing whole results."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
from pandas.testing import assert_frame_equal

DATA = "/root/testdata"


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    for column in frame.columns:
        if frame[column].isna().all():
            frame = frame.assign(**{column: frame[column].astype(object)})
    if frame.empty:
        return frame.reset_index(drop=True)
    return frame.sort_values(list(frame.columns), key=lambda c: c.astype(str)).reset_index(drop=True)


def assert_same(found: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(wanted.columns)
    assert len(found) == len(wanted)
    assert_frame_equal(ordered(found), ordered(wanted), check_dtype=False, check_exact=True)
