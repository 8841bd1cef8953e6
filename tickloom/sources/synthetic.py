"""Generated records: a load generator, and the built-in test provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.times import iso_text
from tickloom.schemas import CANDLE_FIELDS, FUNDING_FIELDS


def candles_by_index(rows: DataFrame, index: str) -> DataFrame:
    """One candle per row, a function of its index; a minute clock wraps daily.

    Beyond 1440 rows keys repeat, and for some indexes high is below close, so the
    result is a workload for the validator too.
    """
    i = F.col(index)

    def number(value: Column) -> Column:
        return value.cast("string")

    hour = F.pmod(F.floor(i / 60), F.lit(24)).cast("string")
    minute = F.pmod(i, F.lit(60)).cast("string")
    # The generator's formulas.
    return rows.select(
        F.lit("fake").alias("exchange"),
        F.lit("BTC/USDT").alias("symbol"),
        F.lit("1h").alias("timeframe"),
        F.concat(
            F.lit("2026-05-27T"),
            F.lpad(hour, 2, "0"),
            F.lit(":"),
            F.lpad(minute, 2, "0"),
            F.lit(":00"),
        ).alias("timestamp"),
        number(100 + i % 50).alias("open"),
        number(110 + i % 50).alias("high"),
        number(90 + i % 30).alias("low"),
        number(105 + i % 40).alias("close"),
        number(10 + (i * 7) % 100).alias("volume"),
        F.lit("benchmark").alias("source"),
        i.cast("long").alias("record_index"),
    )


def synthetic_candles(spark: SparkSession, count: int) -> DataFrame:
    return candles_by_index(spark.range(count), "id")


def fake_candles(requests: DataFrame) -> DataFrame:
    """The test provider's candle for each request ``(symbol, timeframe, start)``."""
    return requests.select(
        F.lit("fake").alias("exchange"),
        "symbol",
        "timeframe",
        iso_text(F.col("start")).alias("timestamp"),
        F.lit("100").alias("open"),
        F.lit("110").alias("high"),
        F.lit("90").alias("low"),
        F.lit("105").alias("close"),
        F.lit("10").alias("volume"),
        F.lit("fake").alias("source"),
    ).select(*CANDLE_FIELDS)


def fake_funding(requests: DataFrame) -> DataFrame:
    """The test provider's funding rate for each request ``(symbol, start)``."""
    return requests.select(
        F.lit("fake").alias("exchange"),
        "symbol",
        iso_text(F.col("start")).alias("timestamp"),
        F.lit("0.0001").alias("rate"),
        F.lit("0.0002").alias("predicted_rate"),
        iso_text(F.col("start") + F.expr("INTERVAL 8 HOURS")).alias("next_funding_time"),
        F.lit("fake").alias("source"),
    ).select(*FUNDING_FIELDS)
