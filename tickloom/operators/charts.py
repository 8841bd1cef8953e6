"""Tables behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.times import iso_to_epoch

PRICES = ("open", "high", "low", "close")


def first_per_second(
    df: DataFrame, keys: Sequence[str] = ("exchange", "symbol", "timeframe")
) -> DataFrame:
    """The earliest row per key and whole second; ties by source.

    A partial aggregate, so a second with very many rows is reduced in each task
    before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = [c for c in ("timestamp", "source") if c in rest]
    first = F.min_by(F.struct(*rest), F.struct(*rank)).alias("first")
    second = iso_to_epoch(F.col("timestamp")).alias("time")
    return (
        df.withColumn("time", second)
        .groupBy(*keys, "time")
        .agg(first)
        .select(*keys, "time", *[f"first.{c}" for c in rest])
    )


def chart_series(
    df: DataFrame, keys: Sequence[str] = ("exchange", "symbol", "timeframe")
) -> DataFrame:
    """``(key..., time, open, high, low, close, volume)`` with numbers as doubles."""
    return first_per_second(df, keys).select(
        *keys, "time", *[F.col(c).cast("double").alias(c) for c in (*PRICES, "volume")]
    )


def funding_series(df: DataFrame, keys: Sequence[str] = ("exchange", "symbol")) -> DataFrame:
    """``(key..., time, series, value)``: one line per rate column."""
    return df.select(
        *keys,
        iso_to_epoch(F.col("timestamp")).alias("time"),
        F.col("rate").cast("double").alias("rate"),
        F.col("predicted_rate").cast("double").alias("predicted_rate"),
    ).unpivot([*keys, "time"], ["rate", "predicted_rate"], "series", "value")


def largest_dataset(
    df: DataFrame, keys: Sequence[str] = ("exchange", "symbol", "timeframe")
) -> DataFrame:
    """Rows of the dataset with the most rows; the first by key among equals.

    The broadcast side is one row.
    """
    winner = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), *keys)
        .limit(1)
        .drop("_n")
    )
    return df.join(F.broadcast(winner), list(keys), "left_semi")
