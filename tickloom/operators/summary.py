"""Dataset listings, counts and column statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.schemas import CANDLE, FUNDING, RecordKind
from tickloom.sources.catalogue import known_datasets
from tickloom.sources.layout import DATE, folder, path_exists, stored_schema
from tickloom.sources.store import list_files

DATASET = ("type", "exchange", "symbol", "timeframe")


def _dataset_columns(kind: RecordKind) -> list:
    timeframe = F.col("timeframe") if kind is CANDLE else F.lit(None).cast("string")
    return [
        F.lit(kind.name).alias("type"),
        F.col("exchange"),
        F.col("symbol"),
        timeframe.alias("timeframe"),
    ]


def dataset_rows(df: DataFrame, kind: RecordKind) -> DataFrame:
    """Rows per dataset of any table of this kind."""
    return df.select(*_dataset_columns(kind)).groupBy(*DATASET).agg(
        F.count(F.lit(1)).alias("rows")
    )


def dataset_summary(spark: SparkSession, root: str) -> DataFrame:
    """``(type, exchange, symbol, timeframe, files, rows)`` of the whole store.

    It comes from the catalogue that the writes keep. Where that does not cover the files
    that are there, the store is counted: the scan reads key columns only, and an unreadable file does not fail the others: files
    that give no row are counted with 0 rows, under what their folders tell about them.
    Counting per file first keeps the shuffle at one row per dataset and file.
    """
    parts = []
    for kind in (CANDLE, FUNDING):
        base = folder(root, kind)
        if not path_exists(spark, base):
            continue
        known = known_datasets(spark, root, kind)
        if known is not None:
            parts.append(known.select(F.lit(kind.name).alias("type"), *known.columns))
            continue
        stored = (
            spark.read.schema(stored_schema(kind)).option("ignoreCorruptFiles", True).parquet(base)
        )
        keyed = stored.select(*_dataset_columns(kind), F.col("_metadata.file_path").alias("path"))
        per_file = keyed.groupBy(*DATASET, "path").agg(F.count(F.lit(1)).alias("n"))
        parts.append(
            per_file.groupBy(*DATASET).agg(
                F.count(F.lit(1)).alias("files"), F.sum("n").alias("rows")
            )
        )
        parts.append(_rowless(list_files(spark, base), per_file, kind))
    if not parts:
        return spark.createDataFrame(
            [],
            "type string, exchange string, symbol string, timeframe string, files long, rows long",
        )
    return reduce(DataFrame.unionByName, parts)


def _rowless(listing: DataFrame, read: DataFrame, kind: RecordKind) -> DataFrame:
    """Files of a listing that gave no rows, per dataset as far as their path names it."""

    def plain(path: Column) -> Column:
        return F.regexp_replace(path, "^[a-zA-Z0-9]+:/+", "/")

    # The scan's paths are escaped once more than those of the listing.
    seen = read.select(
        plain(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))).alias("_path")
    ).distinct()

    def folder_value(name: str) -> Column:
        value = F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
        return F.try_url_decode(F.when(value != "", F.replace(value, F.lit("+"), F.lit("%2B"))))

    timeframe = folder_value("timeframe") if kind is CANDLE else F.lit(None).cast("string")
    return (
        listing.withColumn("_path", plain(F.col("path")))
        .join(seen, "_path", "left_anti")
        .select(
            F.lit(kind.name).alias("type"),
            folder_value("exchange").alias("exchange"),
            folder_value("symbol").alias("symbol"),
            timeframe.alias("timeframe"),
        )
        .groupBy(*DATASET)
        .agg(F.count(F.lit(1)).alias("files"), F.lit(0).cast("long").alias("rows"))
    )


def listing_summary(listing: DataFrame, counts: DataFrame) -> DataFrame:
    """Summary from a file listing and row counts: a dataset without rows shows 0."""
    files = listing.groupBy(*DATASET).agg(F.count(F.lit(1)).alias("files"))
    found = counts.select(*[F.col(c).alias(f"_{c}") for c in DATASET], "rows")
    same = None
    for c in DATASET:
        part = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = part if same is None else same & part
    return files.join(found, same, "left").select(
        *DATASET, "files", F.coalesce("rows", F.lit(0)).alias("rows")
    )


def list_datasets(summary: DataFrame) -> DataFrame:
    """``(type, dataset)`` names without the test provider."""
    anchor = F.coalesce(F.col("timeframe"), F.lit(FUNDING.name))
    return (
        summary.where(F.col("exchange") != "fake")
        .select("type", F.concat_ws("/", "exchange", "symbol", anchor).alias("dataset"))
        .distinct()
    )


def column_stats(df: DataFrame) -> DataFrame:
    """``(name, nulls, min, max)`` per column in one pass; min/max of decimals only."""
    aggregates, entries = [], []
    for i, field in enumerate(df.schema):
        column = F.col(f"`{field.name}`")
        aggregates.append(F.count_if(column.isNull()).alias(f"n{i}"))
        low = high = F.lit(None).cast("string")
        if isinstance(field.dataType, T.DecimalType):
            aggregates += [F.min(column).alias(f"l{i}"), F.max(column).alias(f"h{i}")]
            low, high = F.col(f"l{i}").cast("string"), F.col(f"h{i}").cast("string")
        entries.append(
            F.struct(
                F.lit(field.name).alias("name"),
                F.col(f"n{i}").alias("nulls"),
                low.alias("min"),
                high.alias("max"),
            )
        )
    return df.agg(*aggregates).select(F.explode(F.array(*entries)).alias("s")).select("s.*")


def footer_counts(spark: SparkSession, root: str, kind: RecordKind) -> DataFrame:
    """``(name, nulls, rows)`` per column in the store's files, from their footers alone.

    Spark pushes these counts down into the file metadata, so no row group is read. That
    takes its newer Parquet reader, which a session of its own uses. Columns that are
    folders have no nulls and are not listed.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    base = folder(root, kind)
    schema = stored_schema(kind)
    if path_exists(spark, base):
        rows = session.read.schema(schema).parquet(base)
        folders = set(_folder_columns(spark, base))
    else:
        rows, folders = session.createDataFrame([], schema), {DATE}
    names = [f.name for f in schema if f.name not in folders]
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"_{i}") for i, c in enumerate(names)]
    )
    entries = [
        F.struct(F.lit(c).alias("name"), (F.col("rows") - F.col(f"_{i}")).alias("nulls"), "rows")
        for i, c in enumerate(names)
    ]
    return counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def _folder_columns(spark: SparkSession, base: str) -> list[str]:
    """The columns that are folders below a table's base."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    files, found = path.getFileSystem(spark._jsc.hadoopConfiguration()), []
    while True:
        names = [s.getPath().getName() for s in files.listStatus(path) if s.isDirectory()]
        names = [n for n in names if "=" in n]
        if not names:
            return found
        found.append(names[0].split("=", 1)[0])
        path = spark._jvm.org.apache.hadoop.fs.Path(path, names[0])


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))


def count_by_symbol(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))


def ingest_counts(batch: DataFrame, kind: RecordKind) -> DataFrame:
    """Rows of a written batch per symbol, in the shape of an ingest result."""
    timeframe = F.col("timeframe") if kind is CANDLE else F.lit(None).cast("string")
    return (
        batch.select(
            F.lit(kind.name).alias("data_type"),
            F.col("exchange").alias("provider"),
            "symbol",
            timeframe.alias("timeframe"),
        )
        .groupBy("data_type", "provider", "symbol", "timeframe")
        .agg(F.count(F.lit(1)).alias("records"))
    )
