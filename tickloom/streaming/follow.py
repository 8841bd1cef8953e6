"""Continuous ingest of landed payloads as a streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.coverage import resume_points
from tickloom.operators.merge import UPSERT
from tickloom.operators.normalise import (
    latest_payload_wins,
    parse_payloads,
    payload_candles,
    payload_rejects,
)
from tickloom.operators.validate import INDEX
from tickloom.plans.ingest import SET, number_records, validated_ingest
from tickloom.schemas import CANDLE
from tickloom.session import shared_dir
from tickloom.sources.layout import MARKET_DAY, Layout
from tickloom.sources.markers import write_batch
from tickloom.sources.payloads import stream_payloads
from tickloom.sources.staging import stage, staging
from tickloom.sources.store import scan
from tickloom.streaming.retries import held_records, next_entries, of_batch, open_failures, record

FAULTY_SCHEMA = "exchange string, symbol string, timeframe string, errors long"
# Where a record came from: its batch, and its payload in the batch.
SENT = ("sent_batch", "landed_at", "file", "payload_no")


def ingest_cycle(
    payloads: DataFrame,
    batch_id: int,
    root: str,
    quarantine: str,
    layout: Layout = MARKET_DAY,
    strategy: str = UPSERT,
    run: str = "follow",
) -> None:
    """One micro-batch: normalise, hold faulty sets back, upsert the rest, mark.

    Sets that failed earlier and come again are tried again: their held records join the
    batch, and keys that were sent again replace them. If ``payloads`` has a ``start``
    per payload, earlier candles are left out.

    Running a batch again ends in the same store: the upsert is by key, it starts from
    the ledger of the batch before, and side tables and log are overwritten per run and
    batch.
    """
    spark = payloads.sparkSession
    numbered = payloads.withColumn("payload_no", F.monotonically_increasing_id())
    with staging(spark) as put:
        parsed = parse_payloads(numbered)
        # The body is kept where it explains a reject.
        body = F.when(F.col("reason").isNotNull(), F.col("body")).alias("body")
        parsed = put(
            parsed.select(*[body if c == "body" else F.col(c) for c in parsed.columns]), "parsed"
        )
        rejects = payload_rejects(parsed)
        write_batch(rejects, f"{quarantine.rstrip('/')}/rejects", run, batch_id)
        before = put(open_failures(spark, quarantine, run, batch_id), "open")
        arrived = put(parsed.select(*SET).distinct(), "arrived")
        due = put(before.join(arrived, list(SET), "left_semi"), "due")

        starts = [c for c in ("start",) if c in parsed.columns]
        rows = payload_candles(parsed, keep=(*SENT[1:], *starts))
        if starts:
            rows = rows.where(F.col("timestamp").cast("timestamp_ntz") >= F.col("start"))
        rows = number_records(rows).withColumn(SENT[0], F.lit(batch_id).cast("long"))
        rows = rows.select(*CANDLE.fields, *SENT, INDEX)
        # Held records come first; a batch of this run is later than any before it.
        again = held_records(due, quarantine, rows.schema)
        again = again.withColumns(
            {SENT[0]: F.lit(-1).cast("long"), INDEX: -1 - F.monotonically_increasing_id()}
        )
        current = latest_payload_wins(rows.unionByName(again), CANDLE.key, SENT)
        validated_ingest(
            current,
            root,
            CANDLE,
            layout=layout,
            strategy=strategy,
            scope=SET,
            quarantine=quarantine,
            batch_id=batch_id,
            mark=True,
            run=run,
        )
        faulty = of_batch(
            spark, f"{quarantine.rstrip('/')}/sets", FAULTY_SCHEMA, run, batch_id
        )
        rejected = rejects.groupBy(*SET).agg(F.max("reason").alias("reason"))
        entries = put(next_entries(before, arrived, faulty, rejected, run, batch_id), "entries")
        record(entries, before, quarantine, run, batch_id)


def _start(
    payloads: DataFrame,
    root: str,
    checkpoint: str,
    quarantine: str,
    every: str | None,
    layout: Layout,
    strategy: str,
) -> StreamingQuery:
    spark = payloads.sparkSession

    def cycle(batch: DataFrame, batch_id: int) -> None:
        # Batch numbers start again with a new checkpoint, and so does the query's id.
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        ingest_cycle(batch, batch_id, root, quarantine, layout, strategy, run)

    writer = payloads.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def follow(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    quarantine: str,
    every: str | None = None,
    max_files_per_trigger: int | None = None,
    layout: Layout = MARKET_DAY,
    strategy: str = UPSERT,
) -> StreamingQuery:
    """Start the ingest: forever with ``every`` ("60 seconds"), else what has landed.

    The checkpoint remembers which files were ingested, so a restart goes on where
    it stopped. One such query per store: partitions are replaced as a whole.
    """
    payloads = stream_payloads(spark, landing, max_files_per_trigger)
    return _start(payloads, root, checkpoint, quarantine, every, layout, strategy)


def follow_since_last(
    spark: SparkSession,
    requests: DataFrame,
    landing: str,
    root: str,
    checkpoint: str,
    quarantine: str,
    every: str | None = None,
    max_files_per_trigger: int | None = None,
    layout: Layout = MARKET_DAY,
    strategy: str = UPSERT,
) -> StreamingQuery:
    """The ingest of the requested sets, each from where the store ends at the start.

    The payload stream is joined with the table of resume points, which is written once:
    payloads of other sets go before they are parsed, and all micro-batches use the
    same points, in whatever order files come. Sets without stored rows are left out;
    ``resume_points`` names them. A second start takes new points, and its
    checkpoint lets it read new files only.
    """
    points = resume_points(requests, scan(spark, root, CANDLE)).where(F.col("problem").isNull())
    starts = stage(points.select(*SET, "start").distinct(), shared_dir(spark, "starts"))
    payloads = stream_payloads(spark, landing, max_files_per_trigger).join(starts, list(SET))
    return _start(payloads, root, checkpoint, quarantine, every, layout, strategy)
