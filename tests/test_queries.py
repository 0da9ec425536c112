"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as registry
from ledgerlight.plans.exports import TABLES

FOLDER = os.environ.get("LEDGERLIGHT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def plain(value):
    return None if isinstance(value, float) and math.isnan(value) else value


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([tuple(plain(row[i]) for i in order) for row in rows], key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    rows = frame.collect()
    if name not in ORACLES:
        assert rows
        return
    answer = duck.execute(ORACLES[name])
    columns = [d[0] for d in answer.description]
    assert sorted(frame.columns) == sorted(columns)
    assert comparable(frame.columns, rows) == comparable(columns, answer.fetchall())


def test_entry(spark):
    assert registry.entry(spark).columns == ["period", "value"]


def test_table_roles_come_from_detected_edges(spark, monkeypatch):
    from ledgerlight.plans import catalogue

    unseen = ("sales", "customer_id", "products", "product_id")
    monkeypatch.setattr(catalogue, "CONFIRMED", {**catalogue.CONFIRMED, unseen: True})
    with pytest.raises(ValueError, match="no such relationship"):
        QUERIES["table_roles"](spark, FOLDER)
