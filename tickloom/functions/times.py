"""Time expressions that do not depend on the session zone, and timeframe lengths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Seconds per timeframe that a resume can step over.
RESUMABLE_SECONDS = {
    "1m": 60,
    "3m": 180,
    "5m": 300,
    "15m": 900,
    "30m": 1800,
    "1h": 3600,
    "2h": 7200,
    "4h": 14400,
    "6h": 21600,
    "8h": 28800,
    "12h": 43200,
    "1d": 86400,
    "3d": 259200,
    "1w": 604800,
}
# Lengths of the other timeframes some exchange offers.
OTHER_SECONDS = {"10s": 10, "30s": 30, "3h": 10800, "2d": 172800, "14d": 1209600}
OTHER_MONTHS = {"1M": 1, "3M": 3}

# Fixed value: accepted range bounds.
BOUND_SHAPE = re.compile(r"\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2})?)?", re.ASCII)


def check_bound(value: str, name: str) -> str:
    """Accept an ISO date or datetime; raise for anything else."""
    if not BOUND_SHAPE.fullmatch(value):
        raise ValueError(
            f"{name!r} must be an ISO-8601 date or datetime "
            f"(2025-01-15 or 2025-01-15T12:00:00), got {value!r}"
        )
    return value


def bound_literal(value: str, name: str) -> Column:
    """A checked bound as a typed literal, so that it reaches the Parquet scan."""
    text = check_bound(value, name)
    return F.lit(text.replace("T", " ")).cast("timestamp_ntz")


def iso_text(value: Column) -> Column:
    """Timestamp -> ``yyyy-MM-ddTHH:mm:ss`` with a fraction only if there is one."""
    return F.regexp_replace(value.cast("timestamp_ntz").cast("string"), " ", "T")


def epoch_to_iso(value: Column, unit: str) -> Column:
    """Epoch seconds (``s``) or milliseconds (``ms``) -> UTC text to the second."""
    if unit not in ("s", "ms"):
        raise ValueError(f"unit must be 's' or 'ms', got {unit!r}")
    seconds = value.cast("long") if unit == "s" else F.floor(value.cast("long") / F.lit(1000))
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    zero = F.lit(0)
    return iso_text(start + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)")))


def iso_to_epoch(value: Column) -> Column:
    """ISO text or timestamp, read as UTC -> whole epoch seconds."""
    stamp = value.cast("timestamp_ntz")
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", start, stamp)


def parse_either(value: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` or ``yyyy-MM-dd``; null for anything else."""
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9]{2}:[0-9]{2}:[0-9]{2})?$"
    return F.when(value.rlike(shape), value.try_cast("timestamp_ntz"))


def timeframe_lengths(spark: SparkSession) -> DataFrame:
    """Dimension ``(timeframe, seconds, months, resumable)``; 21 fixed rows."""
    rows = [(name, secs, 0, True) for name, secs in RESUMABLE_SECONDS.items()]
    rows += [(name, secs, 0, False) for name, secs in OTHER_SECONDS.items()]
    rows += [(name, 0, months, False) for name, months in OTHER_MONTHS.items()]
    return spark.createDataFrame(
        rows, "timeframe string, seconds long, months int, resumable boolean"
    )


def step_after(stamp: Column, seconds: Column, months: Column) -> Column:
    """The time one timeframe after ``stamp``."""
    zero = F.lit(0)
    day_time = F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))
    return stamp + F.make_ym_interval(zero, months) + day_time
