"""The ledger of sets that failed, so that later payloads can complete them.

A set fails in a micro-batch when a rule finds an error in its records, which are then held
back, or when one of its payloads is rejected. It stays open until a later batch brings
payloads of it and nothing fails: then what was held back is stored together with what
came. A key that is sent again replaces its held version, so a corrected page is enough.

The ledger is a table of its own after each batch, next to the quarantine: one row per open
set, and one without names that says the batch was recorded even if none is open. A batch
reads what the batch before it left and writes its own, so a batch that runs again starts from
the same state and replaces what it wrote. A new run (a new checkpoint) takes over the
open sets of the run that recorded last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import drop_table
from tickloom.sources.layout import path_exists
from tickloom.sources.markers import WRITER, write_batch

SET = ("exchange", "symbol", "timeframe")
ENTRY_SCHEMA = (
    "exchange string, symbol string, timeframe string, reason string, attempts int, "
    "failed_run string, failed_batch long, held_run string, held_batch long, noted_at timestamp"
)
_TABLE_SCHEMA = f"{ENTRY_SCHEMA}, run string, batch_id string"
VALIDATION = "VALIDATION"
# Tables of this many earlier batches of a run stay.
KEPT_BATCHES = 2


def _folder(quarantine: str, name: str) -> str:
    return f"{quarantine.rstrip('/')}/{name}"


def of_batch(spark: SparkSession, path: str, schema: str, run: str, batch_id: int) -> DataFrame:
    """What one batch of a run wrote to a side table; empty if nothing."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    names = [c.split()[0] for c in schema.split(", ")]
    rows = spark.read.schema(f"{schema}, run string, batch_id string").parquet(path)
    return rows.where((F.col("run") == run) & (F.col("batch_id") == str(batch_id))).select(*names)


def _ledger(spark: SparkSession, quarantine: str) -> DataFrame | None:
    path = _folder(quarantine, "open")
    if not path_exists(spark, path):
        return None
    return spark.read.schema(_TABLE_SCHEMA).parquet(path)


def _state(ledger: DataFrame, run: str, before: int | None) -> tuple[str, str] | None:
    """Run and batch whose table holds the state before a batch of a run (or now)."""
    number = F.col("batch_id").cast("long")
    known = ledger.where("exchange IS NULL").select("run", "batch_id", number.alias("n"), "noted_at")
    own = known.where(F.col("run") == run)
    if before is not None:
        own = own.where(F.col("n") < before)
    last = own.orderBy(F.desc("n")).first()
    if last is None:
        last = known.where(F.col("run") != run).orderBy(F.desc("noted_at"), F.desc("n")).first()
    return (last["run"], last["batch_id"]) if last else None


def open_failures(
    spark: SparkSession, quarantine: str, run: str = "", before: int | None = None
) -> DataFrame:
    """Open sets before a batch of a run; without one, as the last batch left them."""
    ledger = _ledger(spark, quarantine)
    state = _state(ledger, run, before) if ledger is not None else None
    if state is None:
        return spark.createDataFrame([], ENTRY_SCHEMA)
    rows = ledger.where((F.col("run") == state[0]) & (F.col("batch_id") == state[1]))
    return rows.where("exchange IS NOT NULL").drop(*WRITER)


def held_records(due: DataFrame, quarantine: str, schema: T.StructType) -> DataFrame:
    """Records held back for the given open sets, in the columns of ``schema``."""
    spark = due.sparkSession
    path = _folder(quarantine, "records")
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    places = due.where("held_batch IS NOT NULL").select(
        *SET, F.col("held_run").alias("run"), F.col("held_batch").cast("string").alias("batch_id")
    )
    written = T.StructType([*schema.fields, *[T.StructField(c, T.StringType()) for c in WRITER]])
    rows = spark.read.schema(written).parquet(path)
    return rows.join(places, [*SET, *WRITER], "left_semi").select(*schema.names)


def next_entries(
    before: DataFrame, arrived: DataFrame, faulty: DataFrame, rejected: DataFrame,
    run: str, batch_id: int,
) -> DataFrame:
    """Open sets after a batch.

    ``arrived`` are the sets that the batch brought payloads of, ``faulty`` those held
    back now, ``rejected`` (with ``reason``) those with a payload that gave no records. Sets
    without new payloads stay as they were.
    """
    now = faulty.select(*SET, F.lit(VALIDATION).alias("reason"), F.lit(True).alias("_held"))
    now = now.unionByName(rejected.select(*SET, "reason", F.lit(False).alias("_held")))
    now = now.groupBy(*SET).agg(
        F.max("_held").alias("_held"), F.max_by("reason", F.struct("_held", "reason")).alias("reason")
    )
    old = before.select(*SET, "attempts", "failed_run", "failed_batch")
    failed = now.join(old, list(SET), "left")
    here = [F.when(F.col("_held"), F.lit(x)) for x in (run, batch_id)]
    failed = failed.select(
        *SET,
        "reason",
        (F.coalesce("attempts", F.lit(0)) + 1).alias("attempts"),
        F.coalesce("failed_run", F.lit(run)).alias("failed_run"),
        F.coalesce("failed_batch", F.lit(batch_id)).cast("long").alias("failed_batch"),
        here[0].cast("string").alias("held_run"),
        here[1].cast("long").alias("held_batch"),
        F.current_timestamp().alias("noted_at"),
    )
    waiting = before.join(arrived.select(*SET).distinct(), list(SET), "left_anti")
    return failed.unionByName(waiting)


def record(
    entries: DataFrame, before: DataFrame, quarantine: str, run: str, batch_id: int
) -> None:
    """Write the ledger after a batch, and the sets that the batch completed."""
    spark = entries.sparkSession
    solved = before.join(entries.select(*SET), list(SET), "left_anti").select(
        *SET, "reason", "attempts", "failed_run", "failed_batch"
    )
    write_batch(solved, _folder(quarantine, "solved"), run, batch_id)
    header = spark.range(1).select(
        *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ENTRY_SCHEMA.split(", ")[:-1]],
        F.current_timestamp().alias("noted_at"),
    )
    path = _folder(quarantine, "open")
    write_batch(entries.unionByName(header), path, run, batch_id)
    if batch_id > KEPT_BATCHES:
        drop_table(spark, f"{path}/run={run}/batch_id={batch_id - KEPT_BATCHES - 1}")


def solved_failures(spark: SparkSession, quarantine: str) -> DataFrame:
    """Sets that failed once and were completed, with the run and batch that did it."""
    schema = (
        "exchange string, symbol string, timeframe string, reason string, attempts int, "
        "failed_run string, failed_batch long, run string, batch_id string"
    )
    path = _folder(quarantine, "solved")
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
