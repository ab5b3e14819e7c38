"""Every query that has SQL gives DuckDB's rows on the smallest driver tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from threadloom.plans import demo

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return db


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, float):
        return str(int(value)) if value == int(value) else f"{value:.9g}"
    return str(pd.Timestamp(value)) if hasattr(value, "isoformat") else str(value)


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(demo.queries()))
def test_query(spark, duck, name):
    got = demo.queries()[name](spark, DATA).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in demo.oracle_sql():
        want = duck.execute(demo.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
