"""Every registered query against its SQL counterpart on the smallest tables."""

import glob
import os

import duckdb
import pytest

import check_results
from __spark_entry__ import entry, queries
from oracle.statements import statements
from oresmith.plans.queries import QUERIES

from conftest import SMALL


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, connection):
    outcome = check_results.compare(spark, connection, name, QUERIES[name], statements()[name], SMALL)
    assert outcome.startswith("ok"), outcome


def test_entry(spark):
    assert entry(spark).count() == 793


def test_every_query_has_sql():
    assert set(QUERIES) == set(statements()) and set(QUERIES) <= set(queries())
