"""Every registered query against its SQL, on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from catalogue.oracle import statements
from catalogue.adapter import Star
from catalogue.queries import _stored_client, callables
from rideledger.sources.datasets import Store

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = callables()
SQL = statements()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return connection


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda position: names[position])
    return sorted(tuple(repr(row[position]) for position in order) for row in rows)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(SQL[name])
    names = [column[0] for column in cursor.description]
    assert sorted(df.columns) == sorted(names)
    got = comparable([tuple(row) for row in df.collect()], df.columns)
    assert got == comparable(cursor.fetchall(), names)
    assert got


def test_entry_is_the_breakdown(spark):
    assert contract.entry(spark).columns == [
        "stuurtabel_id", "control_id", "control_name", "total_checked", "total_deviations", "deviation_percentage",
    ]


def test_breakdown_of_two_runs(spark):
    rows = QUERIES["control_breakdown"](spark, "/root/testdata/sf0.01").where("stuurtabel_id in (200106, 200107)")
    got = {(r.stuurtabel_id, r.control_id): (r.control_name, r.total_deviations, r.total_checked, r.deviation_percentage) for r in rows.collect()}
    assert got == {
        (200107, 1): ("Bestelling ook in planning", 244, 821, 29.72),
        (200107, 5): ("Planning mislukt", 44, 152, 28.95),
        (200107, 8): ("Overschrijden reistijd", 142, 697, 20.37),
        (200107, 10): ("Controle 10 - Routekaart (optimalisatie)", 51, 152, 33.55),
        (200107, 11): ("Emissieklasse", 160, 821, 19.49),
        (200106, 1004): ("Emissie", 87, 694, 12.54),
        (200106, 1005): ("Brandstof", 129, 694, 18.59),
        (200106, 1006): ("Leeftijd", 208, 694, 29.97),
    }


def test_dates_are_dates(spark):
    row = QUERIES["report_1_detail"](spark, FOLDER).where("datum is not null").first()
    assert type(row.datum) is datetime.date


def test_a_stored_client_takes_its_runs_by_a_list(spark, monkeypatch):
    """A join with the run list would shuffle all wide rows by run."""
    plans, write = [], Store.write_version

    def seen(store, dataset, rows, version):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return write(store, dataset, rows, version)

    monkeypatch.setattr(Store, "write_version", seen)
    _stored_client(Star(spark, FOLDER))
    assert len(plans) == 3 and not any("LeftSemi" in plan for plan in plans)
