"""Every query runs, has rows, and agrees with its SQL twin."""

import glob
import math
import os

import __spark_entry__
import duckdb
import pytest

from govlens.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def database(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return f"{value:.6g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, database, name):
    found = QUERIES[name](spark, sf_dir)
    cursor = database.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    rows = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in found.collect())
    order = [columns.index(c) for c in sorted(columns)]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
