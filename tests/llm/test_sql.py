"""The training-data queries that SQL can express, against their SQL twins on the smallest tables."""

import glob
import os

import duckdb
import pytest
from govlens.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def database(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, database, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    cursor = database.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in found.collect()) == expected
