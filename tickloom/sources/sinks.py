"""Partition-scoped upserts into the record store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.cast import typed_cast
from tickloom.operators.merge import (
    CHANGES,
    INSERT,
    STRATEGIES,
    UPDATE,
    UPSERT,
    classify_changes,
    upsert_merge,
)
from tickloom.schemas import CANDLE, FUNDING, RecordKind
from tickloom.session import shared_dir
from tickloom.sources.catalogue import catalogued_write
from tickloom.sources.layout import (
    MARKET_DAY,
    Layout,
    folder,
    path_exists,
    with_date,
)
from tickloom.sources.staging import stage, staging
from tickloom.sources.store import scan


def touched_partitions(batch: DataFrame, kind: RecordKind, layout: Layout) -> DataFrame:
    return batch.select(*layout.partitions(kind)).distinct()


def stored_in_touched(
    batch: DataFrame, root: str, kind: RecordKind, layout: Layout
) -> tuple[DataFrame | None, bool]:
    """Stored rows of the partitions a batch touches, and whether it touches any.

    None stands for "nothing stored there yet". The scan is pruned to the batch's days and
    markets, of which only the first and last come to the driver; a semi join keeps
    exactly the touched partitions, however many there are.
    """
    return _stored_in(touched_partitions(batch, kind, layout), root, kind, layout)


def _near(
    touched: DataFrame, root: str, kind: RecordKind, layout: Layout
) -> Callable[[], DataFrame | None] | None:
    """A function that scans the store from the first to the last touched partition.

    None if nothing is touched. The function returns None while there is no store.
    """
    spark, columns = touched.sparkSession, layout.partitions(kind)
    bounds = touched.agg(
        *[f(c).alias(f"{name}_{c}") for c in columns for f, name in ((F.min, "min"), (F.max, "max"))]
    ).first()
    if all(value is None for value in bounds):
        return None

    def near() -> DataFrame | None:
        if not path_exists(spark, folder(root, kind)):
            return None
        rows = scan(spark, root, kind)
        for c in columns:
            if bounds[f"min_{c}"] is not None:
                rows = rows.where(F.col(c).between(bounds[f"min_{c}"], bounds[f"max_{c}"]))
        return rows

    return near


def _stored_in(
    touched: DataFrame, root: str, kind: RecordKind, layout: Layout
) -> tuple[DataFrame | None, bool]:
    near = _near(touched, root, kind, layout)
    rows = near() if near else None
    if rows is None:
        return None, near is not None
    return rows.join(touched, list(layout.partitions(kind)), "left_semi"), True


def write_partitions(rows: DataFrame, root: str, kind: RecordKind, layout: Layout) -> None:
    """Replace the partitions present in ``rows``.

    The rebalance hint brings the rows of a partition together, and lets adaptive
    execution split a partition that is too large for one task into several files.
    """
    columns = layout.partitions(kind)
    (
        rows.hint("rebalance", *[F.col(c) for c in columns])
        .sortWithinPartitions(*layout.sort_columns(kind))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*columns)
        .parquet(folder(root, kind))
    )


def upsert(
    batch: DataFrame,
    root: str,
    kind: RecordKind,
    layout: Layout = MARKET_DAY,
    strategy: str = UPSERT,
    resolution: str = "s",
    incoming_unique: bool = False,
    staged: bool = False,
) -> DataFrame:
    """Merge a batch of raw or typed rows into the store.

    Only partitions present in the batch are read and rewritten; with the
    ``changes`` strategy only those with an inserted or updated row are. Returns
    the rewritten partitions. The new files replace the old ones when the job
    commits, so a job that dies leaves the store as it was. One writer per store: two
    jobs that write the same partition at a time would each keep their own version.

    The typed batch is written to the shared folder first, so its source is computed once
    for the bounds, the merge and the result; ``staged`` says that it is a written table
    already.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    spark = batch.sparkSession
    if dict(batch.dtypes)["timestamp"] == "string":
        batch = typed_cast(batch.select(*kind.fields), kind, resolution)
    incoming = with_date(batch.select(*kind.fields))
    with staging(spark) as put:
        if not staged:
            incoming = put(incoming, "incoming")
        # The result outlives the staged batch.
        touched = stage(touched_partitions(incoming, kind, layout), shared_dir(spark, "touched"))
        near = _near(touched, root, kind, layout)
        if near is None:
            return touched
        key, columns = list(kind.key), list(layout.partitions(kind))
        rows = near()
        existing = None if rows is None else rows.join(touched, columns, "left_semi")
        if existing is None or strategy == UPSERT:
            merged = incoming
            if existing is not None:
                merged = upsert_merge(existing, incoming, key, incoming_unique)
            with catalogued_write(near, root, kind, touched, columns):
                write_partitions(merged, root, kind, layout)
            return touched
        # Written before the store changes: nothing is computed from it again.
        classified = put(classify_changes(existing, incoming, key), "classified")
        return _write_changes(classified, near, root, kind, layout)


def _write_changes(
    classified: DataFrame,
    near: Callable[[], DataFrame | None],
    root: str,
    kind: RecordKind,
    layout: Layout,
) -> DataFrame:
    spark, columns = classified.sparkSession, list(layout.partitions(kind))
    names = classified.where(F.col("action").isin(INSERT, UPDATE)).select(*columns).distinct()
    changed = stage(names, shared_dir(spark, "changed"))
    if not changed.isEmpty():
        rows = classified.join(changed, columns, "left_semi")
        with catalogued_write(near, root, kind, changed, columns):
            write_partitions(rows.drop("action"), root, kind, layout)
    return changed


def write_candles(batch: DataFrame, root: str, **options) -> DataFrame:
    return upsert(batch, root, CANDLE, **options)


def write_funding(batch: DataFrame, root: str, **options) -> DataFrame:
    return upsert(batch, root, FUNDING, **options)


__all__ = [
    "CHANGES",
    "UPSERT",
    "stored_in_touched",
    "touched_partitions",
    "upsert",
    "write_candles",
    "write_funding",
    "write_partitions",
]
