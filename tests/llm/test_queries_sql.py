"""Queries with SQL give the rows of that SQL on the smallest input; runs only where the input is."""

import os
from pathlib import Path

import duckdb
import pytest

from loomgraph.llm import queries

FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no input tables")


@pytest.mark.parametrize("name", queries.ORACLES)
def test_same_rows(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    frame = queries.QUERIES[name](spark, str(FOLDER))
    found = db.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(repr, map(tuple, frame.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))
