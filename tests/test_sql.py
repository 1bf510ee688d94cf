"""Every core query with SQL gives the rows of that SQL on the smallest input; runs only where the input is. TEST_SQL=name,name runs only these."""

import datetime
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from loomgraph.plans import exports, graph, hybrid, problems, retrieval

FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
SQL = {n: (m.QUERIES[n], m.ORACLES[n]) for m in (exports, graph, hybrid, problems, retrieval) for n in m.ORACLES if n in os.environ.get('TEST_SQL', n).split(',')}
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no input tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    # what many queries begin with is computed once
    con.execute(f"CREATE SCHEMA shared; CREATE TABLE shared.fr AS {graph._FR} SELECT * FROM fr")
    for name in ("d", "st", "pl", "e", "tu", "ty", "v", "sat", "rights"):
        con.execute(f"CREATE TABLE shared.{name} AS {graph._GRAPH} SELECT * FROM {name}")
    for name in ("plain", "ae"):
        con.execute(f"CREATE TABLE shared.{name} AS {graph._FR} SELECT * FROM {name}")
    return con


def shortened(sql: str) -> str:
    """The query with the tables of `shared` in place of the same ones of its beginning; those that end there are run as they are."""
    rest = sql.removeprefix(graph._FR)
    if rest == sql or not rest.lstrip().startswith(","):
        return sql
    return "WITH RECURSIVE " + ", ".join(f"{t} AS (SELECT * FROM shared.{t})" for t in ("d", "st", "pl", "e", "tu", "ty", "v", "sat", "rights", "fr", "plain", "ae")) + rest


@pytest.mark.parametrize("name", SQL)
def test_same_rows(spark, db, name):
    query, sql = SQL[name]
    frame = query(spark, str(FOLDER))
    columns = sorted(frame.columns)
    got = sorted(repr([plain(x) for x in r]) for r in frame.select(*(f"`{c}`" for c in columns)).collect())
    found = db.execute(shortened(sql))
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    at = [order.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


def test_entry_lists_every_query():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and set(SQL) <= set(sql)
