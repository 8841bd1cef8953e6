"""The ingest log: when each ingest ended and what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.layout import path_exists

LOG_SCHEMA = (
    "data_type string, provider string, symbol string, timeframe string, "
    "records long, ingested_at timestamp_ntz"
)
# Which run and batch wrote an entry: folders of the log.
WRITER = ("run", "batch_id")


def _log(root: str) -> str:
    return f"{root.rstrip('/')}/ingest_log"


def mark_ingest(results: DataFrame, root: str, run: str, batch_id: int) -> None:
    """Log one row per ingested set, in place of what the same batch of a run logged before.

    Works on every store Spark can write to.
    """
    columns = [c.split()[0] for c in LOG_SCHEMA.split(", ")][:-1]
    stamped = results.select(
        *columns, F.date_trunc("second", F.localtimestamp()).cast("timestamp_ntz").alias("ingested_at")
    )
    write_batch(stamped, _log(root), run, batch_id)


def write_batch(rows: DataFrame, path: str, run: str, batch_id: int) -> None:
    """Write the rows of one batch of a run; a repetition replaces them, nothing else does."""
    (
        rows.withColumn("run", F.lit(run))
        .withColumn("batch_id", F.lit(batch_id).cast("long"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*WRITER)
        .parquet(path)
    )


def ingest_log(spark: SparkSession, root: str) -> DataFrame:
    if not path_exists(spark, _log(root)):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(_log(root))


def last_ingest(spark: SparkSession, root: str) -> DataFrame:
    """One row: the time of the last ingest, null if there was none."""
    return ingest_log(spark, root).agg(F.max("ingested_at").alias("last_ingest"))
