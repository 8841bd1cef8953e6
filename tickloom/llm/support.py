"""Shared by the corpus operators: words, written intermediate tables, joins with hot keys."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import shared_dir

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

# A key is hot if it has more than this share of all rows, so there are at most 10,000.
HOT_SHARE = 1 / 10_000
# Below this number of rows a key is never worth spreading.
HOT_ROWS = 1_000


def whole(column: str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Rows that go to a Python worker at once: whole texts, so the default takes much memory on
# both sides. It stays set, as results are computed after the operators return.
BATCH_ROWS, BATCH_SETTING = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
# Rows may be large; then a batch ends with the row that takes it over so many bytes.
BATCH_BYTES, BYTES_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings that hold for a while."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def written(frame: DataFrame, purpose: str, **options: int) -> DataFrame:
    """The rows of a frame, written once to the shared folder and read back.

    This cuts the lineage: whatever is lost later is read again, not computed again,
    and several readers share one computation. As nothing needs them any more, Spark
    removes the shuffle files of the job when the table is written. Options are the writer's.
    """
    spark = frame.sparkSession
    path = shared_dir(spark, purpose)
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    spark.conf.set(BYTES_SETTING, str(BATCH_BYTES))
    with settings(spark, {CLEANUP: "true"}):
        frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def spread_join(
    left: DataFrame, right: DataFrame, key: str, rows: str, spread: Sequence[str]
) -> DataFrame:
    """Left join with a table of one row per key, where one key may hold most left rows.

    ``right`` has the key, ``rows`` (how many left rows the key has, as far as known)
    and further columns, which the result gets. Keys with more than ``HOT_ROWS`` rows
    and ``HOT_SHARE`` of all rows, at most 10,000 of them, are broadcast; their left rows
    are dealt out by a hash of ``spread`` instead of the key, so no task gets them all.
    The hash is fixed by the row, which makes a repeated task repeat its result.
    ``right`` is read twice and should be a written table.
    """
    values = [c for c in right.columns if c != key]
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).scalar()
    hot = right.where((F.col(rows) > HOT_ROWS) & (F.col(rows) > total * HOT_SHARE)).select(
        F.col(key).alias("_hot_key"), *[F.col(c).alias(f"_hot_{c}") for c in values]
    )
    salt = F.when(F.col("_hot_key").isNull(), 0).otherwise(
        1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 30))
    )
    probed = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    probed = probed.withColumn("_salt", salt.cast("int"))
    other = right.withColumn("_salt", F.lit(0))
    joined = probed.join(other, [key, "_salt"], "left")
    return joined.select(
        *[F.col(c) for c in left.columns],
        *[
            F.when(F.col("_hot_key").isNull(), F.col(c)).otherwise(F.col(f"_hot_{c}")).alias(c)
            for c in values
        ],
    )
