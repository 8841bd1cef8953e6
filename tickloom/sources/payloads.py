"""Landed exchange responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("exchange", "symbol", "timeframe")
PAYLOAD_SCHEMA = T.StructType(
    [T.StructField("body", T.StringType()), *[T.StructField(k, T.StringType()) for k in KEY]]
)
_VALUE_SCHEMA = T.StructType(
    [T.StructField("value", T.StringType()), *[T.StructField(k, T.StringType()) for k in KEY]]
)


def write_payloads(payloads: DataFrame, root: str) -> None:
    """Land bodies as text, one per line, in ``exchange=/symbol=/timeframe=`` folders."""
    one_line = F.regexp_replace("body", r"[\r\n]+", " ").alias("value")
    (
        payloads.select(one_line, *KEY)
        .hint("rebalance", *[F.col(k) for k in KEY])
        .write.mode("append")
        .partitionBy(*KEY)
        .text(root)
    )


def landed_payloads(spark: SparkSession, root: str, whole_files: bool = False) -> DataFrame:
    """Payloads ``(exchange, symbol, timeframe, body)``; one per line, or per file."""
    reader = spark.read.schema(_VALUE_SCHEMA).option("wholetext", whole_files)
    return _named(reader.text(root))


def _named(texts: DataFrame) -> DataFrame:
    return texts.select(
        *KEY,
        F.col("value").alias("body"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
        F.col("_metadata.file_path").alias("file"),
    )


def stream_payloads(
    spark: SparkSession,
    root: str,
    max_files_per_trigger: int | None = None,
    whole_files: bool = False,
) -> DataFrame:
    """The same as a stream: files that appear later are read once each."""
    reader = spark.readStream.schema(_VALUE_SCHEMA).option("wholetext", whole_files)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _named(reader.text(root))
