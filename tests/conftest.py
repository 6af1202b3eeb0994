from __future__ import annotations

import glob
import os
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from voxframe.session import local_session, ship_package  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores="4", partitions=4, memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    """A value without its carrier: every kind of NULL is None, numbers are numbers, whatever column held them."""
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, (float, np.floating)) and v != v:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else float(v)
    if isinstance(v, np.integer):
        return int(v)
    return v if isinstance(v, int) else str(v)


def canonical(frame):
    """Rows as sorted texts, columns by name."""
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(map(plain, row))) for row in frame.itertuples(index=False, name=None))


def kinds(frame):
    """Whether each column holds numbers, truth values or something else: pandas makes a whole number with NULLs a float."""

    def kind(column):
        if pd.api.types.is_bool_dtype(column):
            return "truth"
        return "number" if pd.api.types.is_numeric_dtype(column) else "other"

    return {c: kind(frame[c]) for c in frame.columns if len(frame[c].dropna())}


@pytest.fixture(scope="session")
def same_rows():
    def check(left, right):
        assert sorted(left.columns) == sorted(right.columns)
        assert kinds(left) == kinds(right)
        assert canonical(left) == canonical(right)

    return check
