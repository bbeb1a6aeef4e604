"""Every registered query of the feed runs; those with SQL give what DuckDB gives."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from pressmill.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if x is None or x is pd.NaT or isinstance(x, float) and x != x:
        return "null"
    if isinstance(x, (list, tuple)):
        return str([plain(v) for v in x])
    if isinstance(x, bool):
        return str(x)
    try:
        return f"{float(x):.6f}"
    except (TypeError, ValueError):
        return str(x)


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    columns, rows = comparable(got.columns, got.collect())
    if name in SQL:
        want = duck.sql(SQL[name])
        assert (columns, rows) == comparable(want.columns, want.fetchall())
    else:
        assert len(set(columns)) == len(columns)
