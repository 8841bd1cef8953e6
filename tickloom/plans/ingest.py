"""The validation gate in front of the store."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.coverage import resume_points
from tickloom.operators.merge import UPSERT
from tickloom.operators.normalise import FORMATS, parse_payloads, payload_candles
from tickloom.operators.summary import ingest_counts
from tickloom.operators.validate import (
    BROKEN,
    ERROR,
    INDEX,
    batch_verdict,
    validate,
    with_broken,
)
from tickloom.schemas import CANDLE, RecordKind
from tickloom.sources.layout import MARKET_DAY, Layout
from tickloom.sources.markers import mark_ingest, write_batch
from tickloom.sources.sinks import upsert
from tickloom.sources.staging import staging
from tickloom.sources.store import scan

SET = ("exchange", "symbol", "timeframe")


class IngestRejected(ValueError):
    """A batch with errors; nothing of it was written."""

    def __init__(self, issues: int):
        super().__init__(f"Validation failed with {issues} issue(s); no data written.")
        self.issues = issues


@dataclass(frozen=True)
class IngestResult:
    """Records written, records held back, and issues found."""

    written: int
    held_back: int
    issues: int


def number_records(rows: DataFrame) -> DataFrame:
    """Give the rows of a scan distinct numbers.

    Use it where no shuffle lies between the files and the rows: there a task that
    runs again numbers its rows as before.
    """
    return rows.withColumn(INDEX, F.monotonically_increasing_id())


def validated_ingest(
    batch: DataFrame,
    root: str,
    kind: RecordKind,
    layout: Layout = MARKET_DAY,
    strategy: str = UPSERT,
    resolution: str = "s",
    scope: Sequence[str] | None = None,
    quarantine: str | None = None,
    batch_id: int = 0,
    mark: bool = False,
    run: str | None = None,
) -> IngestResult:
    """Write a batch of raw records if no rule finds an error: stage, judge, publish.

    An error rejects the whole batch; with ``scope``, only the sets (for instance
    symbols) that have an error are held back. Held back records, their issues and the
    sets go to ``quarantine`` if it is given; without scope and quarantine the job raises.

    The batch, which needs a distinct ``record_index``, is written once to the shared
    folder, each record with the checks that it breaks. Everything after that reads the
    staged files: the verdict, the issues, what is held back, and the merge into the store.
    So the source is read once, also if executors are lost between verdict and write, and
    record numbers are what they were when the batch was judged. ``mark`` adds the written
    sets to the ingest log.
    Side tables and log are kept per ``run`` and batch: repeating a batch of a named run
    replaces its entries, and a call without a name is a run of its own.
    """
    run = run or uuid.uuid4().hex
    with staging(batch.sparkSession) as put:
        staged = put(with_broken(batch, kind, resolution), "staged")
        verdict = batch_verdict(staged, kind, storage=resolution).first()
        rows, held = staged.drop(BROKEN), 0
        good = rows
        if not verdict["passed"]:
            if scope is None and quarantine is None:
                raise IngestRejected(verdict["issues"])
            issues = validate(
                rows, kind, storage=resolution, keep=[c for c in scope or () if c in kind.fields]
            )
            if quarantine:
                issues = put(issues, "issues")
            good, held = _hold_back(rows, issues, scope, quarantine, (run, batch_id), put)
        # No error means no repeated key, so the merge can rely on that.
        upsert(good, root, kind, layout, strategy, resolution, incoming_unique=True, staged=True)
        written = verdict["records"] - held
        if mark and written:
            mark_ingest(ingest_counts(good, kind), root, run, batch_id)
        return IngestResult(written, held, verdict["issues"])


def _hold_back(
    batch: DataFrame,
    issues: DataFrame,
    scope: Sequence[str] | None,
    quarantine: str | None,
    writer: tuple[str, int],
    put: Callable[[DataFrame, str], DataFrame],
) -> tuple[DataFrame, int]:
    """Split off the sets with errors; without scope the whole batch is one set."""
    sets = [c for c in (scope or ()) if c in issues.columns]
    if sets:
        errors = issues.where(F.col("severity") == ERROR)
        faulty = put(errors.groupBy(*sets).agg(F.count(F.lit(1)).alias("errors")), "faulty")
        same = reduce(and_, [batch[c].eqNullSafe(faulty[c]) for c in sets])
        good = batch.join(faulty, same, "left_anti")
        bad = batch.join(faulty, same, "left_semi")
        if quarantine:
            write_batch(faulty, f"{quarantine.rstrip('/')}/sets", *writer)
    else:
        good, bad = batch.limit(0), batch
    held = bad.count()
    if quarantine:
        for rows, name in ((bad, "records"), (issues, "issues")):
            write_batch(rows, f"{quarantine.rstrip('/')}/{name}", *writer)
    return good, held


def incremental_backfill(
    spark: SparkSession, requests: DataFrame, payloads: DataFrame, root: str, **options
) -> IngestResult:
    """Ingest landed payloads of the requested sets from where the store ends.

    Sets without stored rows are left out; ``resume_points`` names them. The points are
    written to the shared folder before the store changes. The exchanges among them, of
    which there are no more than formats, prune the payload folders. The stream that goes
    on from there is ``follow_since_last``.
    """
    points = resume_points(requests, scan(spark, root, CANDLE)).where(F.col("problem").isNull())
    with staging(spark) as put:
        starts = put(points.select(*SET, "start").distinct(), "starts")
        known = starts.where(F.col("exchange").isin(*FORMATS)).select("exchange").distinct()
        asked = payloads.where(F.col("exchange").isin(sorted(r["exchange"] for r in known.collect())))
        rows = number_records(payload_candles(parse_payloads(asked)))
        fresh = rows.join(starts, list(SET)).where(
            F.col("timestamp").cast("timestamp_ntz") >= F.col("start")
        )
        return validated_ingest(fresh.select(*CANDLE.fields, INDEX), root, CANDLE, **options)
