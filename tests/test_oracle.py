"""Every registered query against its SQL twin on whole test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
from ridemetrics.plans import catalog

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["events", "customer", "orders", "part"]
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([row[i] for i in order] for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    result = spark_entry.queries()[name](spark, SF_DIR)
    oracle = duck.execute(spark_entry.oracle_sql()[name])
    duck_types = {d[0]: str(d[1]) for d in oracle.description}
    assert {c: TYPES[t] for c, t in result.dtypes} == duck_types
    columns = result.columns
    got = canonical([tuple(row) for row in result.collect()], columns)
    want = canonical(oracle.fetchall(), [d[0] for d in oracle.description])
    assert len(got) > 0
    assert got == want


def test_entry_runs(spark):
    assert spark_entry.entry(spark).columns == ["hour_of_day", "rides"]
