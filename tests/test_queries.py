"""Every registered query against its SQL on the small tables."""

import pathlib
import sys

import duckdb
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tickloom.plans import QUERIES  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, sf_dir, name):
    frame = entry.queries()[name](spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    found = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(names)
    assert got == rows_of(names, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
