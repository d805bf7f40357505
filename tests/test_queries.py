"""Every registered query against its SQL twin, on the smallest test tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from opatlas.plans.oracle import ORACLE_SQL
from opatlas.plans.queries import QUERIES

SF_DIR = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in sorted(SF_DIR.glob("*.parquet")):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def normalized(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(value) for value in row) for row in frame.itertuples(index=False, name=None))


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_twin(spark, tables, name):
    got = entry.queries()[name](spark, str(SF_DIR)).toPandas()
    want = tables.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert normalized(got) == normalized(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
