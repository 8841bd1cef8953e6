"""Tables that a job writes once, reads several times, and removes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tickloom.session import drop_table, shared_dir


def stage(rows: DataFrame, path: str) -> DataFrame:
    """Write the rows and read them back: nothing is computed from their source again."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator:
    """A function that stages tables in the shared folder until the block ends."""
    paths: list[str] = []

    def put(rows: DataFrame, purpose: str) -> DataFrame:
        paths.append(shared_dir(spark, purpose))
        return stage(rows, paths[-1])

    try:
        yield put
    finally:
        for path in paths:
            drop_table(spark, path)
