"""Every registered query against its check SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import TABLES, rows_of  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402
from hearthline.plans import registry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    got = [tuple(r) for r in frame.collect()]
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, got) == rows_of(columns, cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_module_has_the_registry():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    frame = entry_module.entry(spark)
    assert frame.columns[:2] == ["source", "source_id"]
    assert frame.count() > 0
