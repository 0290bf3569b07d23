"""Queries of this package with an SQL counterpart, and the duties of the others."""

import duckdb
import pytest

import check_results
from oresmith.llm.oracle import statements
from oresmith.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(statements()))
def test_query_against_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    outcome = check_results.compare(spark, connection, name, QUERIES[name], statements()[name], FOLDER)
    assert outcome.startswith("ok"), outcome


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
