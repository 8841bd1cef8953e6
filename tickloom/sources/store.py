"""Scans of the record store, file listings and footers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.times import bound_literal, check_bound
from tickloom.schemas import CANDLE, FUNDING, RecordKind
from tickloom.sources.layout import DATE, MARKET_DAY, Layout, folder, path_exists, stored_schema


# Folders of one level that a pruned read names at most; above, Spark lists what is below.
MOST_FOLDERS = 10_000


@dataclass(frozen=True)
class Asked:
    """What a read asks for: null bounds mean everything. Days are the first and the last."""

    exchange: str | None = None
    symbol: str | None = None
    timeframe: str | None = None
    first_day: str | None = None
    last_day: str | None = None

    @staticmethod
    def of(
        exchange: str | None = None,
        symbol: str | None = None,
        timeframe: str | None = None,
        start: str | None = None,
        end: str | None = None,
    ) -> Asked:
        """From the arguments of a typed read, with ``start <= time < end``."""
        days = [check_bound(t, n)[:10] if t else None for t, n in ((start, "start"), (end, "end"))]
        return Asked(exchange or None, symbol or None, timeframe or None, *days)

    def exact(self, column: str) -> str | None:
        return getattr(self, column) if column in ("exchange", "symbol", "timeframe") else None

    def holds(self, column: str, value: str) -> bool:
        if column != DATE:
            return self.exact(column) in (None, value)
        return (self.first_day or value) <= value <= (self.last_day or value)


def asked_folders(spark: SparkSession, base: str, asked: Asked) -> list[str]:
    """The folders below ``base`` that can hold what is asked for.

    Level by level, only folders that match are looked into: a named exchange, symbol or
    timeframe is one folder, which is not even listed among its neighbours. A level with more than
    ``MOST_FOLDERS`` matching folders is left to Spark, whose partition filters cut it.
    """
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(base)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName

    def children(path, column: str | None):
        """The partition folders of a folder, one by one."""
        entries = files.listStatusIterator(path)
        while entries.hasNext():
            entry = entries.next()
            name = entry.getPath().getName()
            if entry.isDirectory() and "=" in name and (column is None or name.startswith(f"{column}=")):
                yield name

    level = [top]
    while True:
        found = []
        for path in level:
            first = next(children(path, None), None)
            if first is None:
                # Below are files.
                return [p.toString() for p in level]
            column = unescape(first.split("=", 1)[0])
            exact = asked.exact(column)
            if exact is not None:
                child = jvm.org.apache.hadoop.fs.Path(path, f"{column}={escape(exact)}")
                found += [child] if files.exists(child) else []
                continue
            for name in children(path, column):
                if asked.holds(column, unescape(name.split("=", 1)[1])):
                    found.append(jvm.org.apache.hadoop.fs.Path(path, name))
                if len(found) > MOST_FOLDERS:
                    return [p.toString() for p in level]
        level = found
        if not level:
            return []


def scan(
    spark: SparkSession, root: str, kind: RecordKind, asked: Asked | None = None
) -> DataFrame:
    """All stored rows of a kind, with the ``date`` partition column; empty if none.

    With ``asked`` the read lists the folders that can hold it, whatever else the store has; rows
    in them that were not asked for are left to filters.
    """
    base, schema = folder(root, kind), stored_schema(kind)
    if not path_exists(spark, base):
        return spark.createDataFrame([], schema)
    paths = asked_folders(spark, base, asked) if asked else [base]
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", base).parquet(*paths)
    return rows.select(*schema.names)


def scan_candles(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, CANDLE)


def scan_funding(spark: SparkSession, root: str) -> DataFrame:
    return scan(spark, root, FUNDING)


def scan_plain(spark: SparkSession, root: str, kind: RecordKind) -> DataFrame:
    """Rows of plain ``exchange/symbol/anchor/date.parquet`` trees, where the files
    themselves hold all columns; for reading stores laid out that way.

    The path condition is on a file attribute, so files of the other kind are
    skipped before they are opened.
    """
    funding = F.col("_metadata.file_path").rlike(f"/{FUNDING.name}/[^/]+$")
    return (
        spark.read.schema(kind.typed_schema)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(root)
        .where(funding if kind is FUNDING else ~funding)
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of the Parquet files under a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length")
    )


def dataset_of_path(path: Column, root: str) -> Column:
    """Path ``exchange/symbol.../anchor/file`` below root -> its dataset, or null.

    A symbol with slashes spans several folders; the folder above the file is the
    timeframe, or ``funding_rate``.
    """
    below = F.regexp_replace(path, "^[a-zA-Z0-9]+:/+", "/")
    prefix = "/" + root.split(":", 1)[-1].strip("/") + "/"
    tail = F.substring(below, F.lit(len(prefix) + 1), F.length(below))
    parts = F.filter(F.split(tail, "/"), lambda p: p != "")
    anchor = F.try_element_at(parts, F.lit(-2))
    funding = anchor == FUNDING.name
    return F.when(
        F.size(parts) >= 3,
        F.struct(
            F.when(funding, FUNDING.name).otherwise(CANDLE.name).alias("type"),
            F.try_element_at(parts, F.lit(1)).alias("exchange"),
            F.array_join(
                F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 3, F.lit(0))), "/"
            ).alias("symbol"),
            F.when(~funding, anchor).alias("timeframe"),
        ),
    )


def discover_plain(files: DataFrame, root: str) -> DataFrame:
    """Datasets of files in plain ``exchange/symbol/anchor/file`` folders."""
    found = files.select(dataset_of_path(F.col("path"), root).alias("d"), "path")
    return found.where(F.col("d").isNotNull()).select("d.*", "path")


def discover_datasets(spark: SparkSession, root: str) -> DataFrame:
    """``(type, exchange, symbol, timeframe, path)`` of every file and dataset in it.

    Keys come from columns, never from the escaped path. Only the key columns are
    read, and each file contributes one row per dataset after partial aggregation.
    """
    parts = []
    for kind in (CANDLE, FUNDING):
        if not path_exists(spark, folder(root, kind)):
            continue
        timeframe = F.col("timeframe") if kind is CANDLE else F.lit(None).cast("string")
        parts.append(
            scan(spark, root, kind)
            .select(
                F.lit(kind.name).alias("type"),
                "exchange",
                "symbol",
                timeframe.alias("timeframe"),
                F.col("_metadata.file_path").alias("path"),
            )
            .distinct()
        )
    if not parts:
        return spark.createDataFrame(
            [], "type string, exchange string, symbol string, timeframe string, path string"
        )
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def inspect_scan(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """One Parquet file or a whole tree, optionally cut to ``[start, end)``.

    Below ``key=value`` folders the keys become columns; other trees are read as
    one table of their files.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Path does not exist: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    example = path
    if file_system.getFileStatus(target).isFile():
        if not path.endswith(".parquet"):
            raise ValueError(f"Not a parquet file: {path}")
    else:
        first = list_files(spark, path).select("path").first()
        if first is None:
            raise ValueError(f"No parquet files found under {path}")
        example = first["path"]
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    hive = re.search(r"/[^/=]+=[^/]*/", example)
    if hive:
        rows = reader.option("basePath", example[: hive.start()]).parquet(path)
    else:
        rows = reader.option("recursiveFileLookup", True).parquet(path)
    # Below ``date=`` folders the days outside the bounds are not read.
    dated = hive and DATE in rows.columns
    if start:
        rows = rows.where(F.col("timestamp") >= bound_literal(start, "start"))
        if dated:
            rows = rows.where(F.col(DATE) >= check_bound(start, "start")[:10])
    if end:
        rows = rows.where(F.col("timestamp") < bound_literal(end, "end"))
        if dated:
            rows = rows.where(F.col(DATE) <= check_bound(end, "end")[:10])
    return rows


FOOTER_SCHEMA = (
    "path string, created_by string, file_rows long, row_groups int, columns int, "
    "row_group int, rows long, total_byte_size long, compression string"
)


def _read_footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    for batch in batches:
        rows = []
        for uri in batch["path"]:
            parsed = urlparse(uri)
            if parsed.scheme in ("", "file"):
                file_system, path = pafs.LocalFileSystem(), unquote(parsed.path)
            else:
                scheme = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(
                    parsed.scheme, parsed.scheme
                )
                file_system, path = pafs.FileSystem.from_uri(
                    uri.replace(parsed.scheme, scheme, 1)
                )
            with file_system.open_input_file(path) as source:
                meta = pq.read_metadata(source)
            for i in range(max(meta.num_row_groups, 1)):
                group = meta.row_group(i) if i < meta.num_row_groups else None
                rows.append(
                    (
                        uri,
                        meta.created_by or "unknown",
                        meta.num_rows,
                        meta.num_row_groups,
                        meta.num_columns,
                        i if group else None,
                        group.num_rows if group else 0,
                        group.total_byte_size if group else 0,
                        group.column(0).compression
                        if group and group.num_columns
                        else "unknown",
                    )
                )
        names = [f.strip().split(" ")[0] for f in FOOTER_SCHEMA.split(",")]
        yield pd.DataFrame(rows, columns=names)


def file_footers(spark: SparkSession, root: str) -> DataFrame:
    """One row per Parquet row group; executors read the footers, not the data."""
    paths = list_files(spark, root).select("path")
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    return paths.repartition(4 * tasks, "path").mapInPandas(_read_footers, FOOTER_SCHEMA)


__all__ = [
    "Asked",
    "asked_folders",
    "MARKET_DAY",
    "Layout",
    "dataset_of_path",
    "discover_datasets",
    "discover_plain",
    "file_footers",
    "inspect_scan",
    "list_files",
    "scan",
    "scan_candles",
    "scan_funding",
    "scan_plain",
]
