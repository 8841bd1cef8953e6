"""A catalogue of datasets: rows and files of each, kept up to date by the writes.

Every write of the store counts the key columns of the partitions that it replaces, before
and after, and appends the difference per dataset. So reading the catalogue adds up small
tables and never scans the store. After ``COMPACT_AFTER`` changes the sum is written as
a new base and the changes before it go.

A marker stands while a write is under way. If a job dies between the store's commit and the
change, the marker stays, the catalogue counts as unknown, and ``refresh_catalogue`` recounts
the store; the next write does so by itself. So does ``known_datasets`` check that the
store has as many files as the catalogue says, which costs a listing: files that came or
went by other ways make it unknown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schemas import CANDLE, RecordKind
from tickloom.session import drop_table
from tickloom.sources.layout import folder, path_exists
from tickloom.sources.staging import staging
from tickloom.sources.store import list_files, scan

COMPACT_AFTER = 20
_KEY = ("exchange", "symbol", "timeframe")
# A row without names and ``total`` counts the files of all datasets, each once.
_SCHEMA = "exchange string, symbol string, timeframe string, total boolean, files long, rows long"
_BASE, _CHANGE, _PENDING = "base-", "change-", "pending-"


def _home(root: str, kind: RecordKind) -> str:
    """A folder that reads of the whole tree pass over, as its name begins with ``_``."""
    return f"{root.rstrip('/')}/_catalogue/{kind.folder}"


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; there are at most some dozens in a catalogue."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(target))


def _version(name: str) -> int:
    return int(name.rsplit("-", 1)[1])


def _complete(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/_SUCCESS")


def _parts(spark: SparkSession, home: str) -> list[str] | None:
    """The newest base and the changes after it; None if there is no base."""
    names = [n for n in _names(spark, home) if _complete(spark, f"{home}/{n}")]
    bases = [n for n in names if n.startswith(_BASE)]
    if not bases:
        return None
    last = max(bases, key=_version)
    changes = [n for n in names if n.startswith(_CHANGE) and _version(n) > _version(last)]
    return [last, *changes]


def _sum(rows: DataFrame) -> DataFrame:
    totals = rows.groupBy(*_KEY, "total").agg(F.sum("files").alias("files"), F.sum("rows").alias("rows"))
    return totals.where("files <> 0 OR rows <> 0")


def _read(spark: SparkSession, home: str, parts: list[str]) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(*[f"{home}/{p}" for p in parts])


def _counts(
    rows: DataFrame, kind: RecordKind, sign: int, touched: DataFrame | None = None,
    columns: Sequence[str] = (),
) -> DataFrame:
    """Signed rows and files per dataset of stored rows, and the files of all."""
    timeframe = F.col("timeframe") if kind is CANDLE else F.lit(None).cast("string")
    named = [*columns, *[c for c in ("exchange", "symbol") if c not in columns]]
    keyed = rows.select(
        *named,
        *([] if "timeframe" in columns else [timeframe.alias("timeframe")]),
        F.col("_metadata.file_path").alias("path"),
    )
    if touched is not None:
        keyed = keyed.join(touched, list(columns), "left_semi")
    per_file = keyed.groupBy(*_KEY, "path").agg(F.count(F.lit(1)).alias("n"))
    datasets = per_file.groupBy(*_KEY).agg(
        F.count(F.lit(1)).alias("files"), F.sum("n").alias("rows")
    )
    whole = per_file.select("path").distinct().agg(F.count(F.lit(1)).alias("files"))
    names = [F.lit(None).cast("string").alias(c) for c in _KEY]
    listed = datasets.select(*_KEY, F.lit(False).alias("total"), "files", "rows").unionByName(
        whole.select(*names, F.lit(True).alias("total"), "files", F.lit(0).cast("long").alias("rows"))
    )
    return listed.withColumns({c: F.col(c) * sign for c in ("files", "rows")})


def _put(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def _mark(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)


def refresh_catalogue(spark: SparkSession, root: str, kind: RecordKind) -> None:
    """Recount the store, which scans its key columns, and start a new base."""
    home = _home(root, kind)
    names = _names(spark, home)
    version = max([0, *map(_version, names)]) + 1
    if path_exists(spark, folder(root, kind)):
        rows = _counts(scan(spark, root, kind), kind, 1)
    else:
        rows = spark.createDataFrame([], _SCHEMA)
    _put(rows, f"{home}/{_BASE}{version}")
    for name in names:
        drop_table(spark, f"{home}/{name}")


def _usable(spark: SparkSession, home: str) -> bool:
    names = _names(spark, home)
    return _parts(spark, home) is not None and not any(n.startswith(_PENDING) for n in names)


@contextmanager
def catalogued_write(
    near: Callable[[], DataFrame | None],
    root: str,
    kind: RecordKind,
    touched: DataFrame,
    columns: Sequence[str],
) -> Iterator[None]:
    """Note what the write in this block changes in the touched partitions.

    ``near`` scans the store around them; it returns None if there is no store yet.
    """
    spark, home = touched.sparkSession, _home(root, kind)
    if not _usable(spark, home):
        refresh_catalogue(spark, root, kind)
    version = max(map(_version, _names(spark, home))) + 1
    pending = f"{home}/{_PENDING}{version}"
    with staging(spark) as put:
        before, rows = spark.createDataFrame([], _SCHEMA), near()
        if rows is not None:
            before = put(_counts(rows, kind, -1, touched, columns), "counted")
        _mark(spark, pending)
        yield
        after = _counts(near(), kind, 1, touched, columns)
        _put(_sum(before.unionByName(after)), f"{home}/{_CHANGE}{version}")
    drop_table(spark, pending)
    parts = _parts(spark, home)
    if parts and len(parts) > COMPACT_AFTER:
        _put(_sum(_read(spark, home, parts)), f"{home}/{_BASE}{version}")
        for name in parts:
            drop_table(spark, f"{home}/{name}")


def known_datasets(spark: SparkSession, root: str, kind: RecordKind) -> DataFrame | None:
    """``(exchange, symbol, timeframe, files, rows)`` from the catalogue; None if it is unknown."""
    home = _home(root, kind)
    if not _usable(spark, home):
        return None
    rows = _sum(_read(spark, home, _parts(spark, home)))
    total = rows.where("total").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
    if total != list_files(spark, folder(root, kind)).count():
        return None
    return rows.where("NOT total").select(*_KEY, "files", "rows")
