"""Every corpus query that SQL can express against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tickloom.llm import ORACLES, QUERIES
from tools.check import TABLES, rows_of


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, sf_dir, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    frame = QUERIES[name](spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    found = db.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(names)
    assert got == rows_of(names, found.fetchall())


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
