"""Registered queries against their SQL, and that all of them are registered."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from rideledger.llm.queries import callables, statements

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "benchmark", "labels", "conversations"]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda position: names[position])
    return sorted(tuple(repr(row[position]) for position in order) for row in rows)


def test_all_are_registered():
    numbers = sorted(int(match[1]) for name in callables() if (match := re.match(r"op(\d+)_", name)))
    assert numbers == list(range(1, 14)) and "pipeline" in callables()
    assert set(callables()) <= set(contract.queries()) and set(statements()) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(statements()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df = callables()[name](spark, FOLDER)
    cursor = duck.execute(statements()[name])
    names = [column[0] for column in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert comparable([tuple(row) for row in df.collect()], df.columns) == comparable(cursor.fetchall(), names)
