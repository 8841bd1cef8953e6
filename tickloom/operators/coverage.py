"""Where to resume, and whether stored data covers a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.times import step_after, timeframe_lengths

KEY = ("exchange", "symbol", "timeframe")


def resume_points(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Start of the next fetch per requested set: last stored time + one timeframe.

    Sets without stored rows, and timeframes of unknown length, get a ``problem``
    instead. The stored side shrinks to one row per set before the join.
    """
    last = stored.groupBy(*KEY).agg(F.max("timestamp").alias("last_timestamp"))
    lengths = F.broadcast(timeframe_lengths(requests.sparkSession))
    asked = requests.join(last, list(KEY), "left")
    joined = asked.join(lengths, "timeframe", "left")
    known = F.coalesce(F.col("resumable"), F.lit(False))
    problem = F.when(~known, "unknown timeframe").when(
        F.col("last_timestamp").isNull(), "no stored data"
    )
    start = F.when(
        problem.isNull(),
        step_after(F.col("last_timestamp"), F.col("seconds"), F.col("months")),
    )
    return joined.select(*KEY, "last_timestamp", start.alias("start"), problem.alias("problem"))


def coverage_check(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """``refused`` where the earliest stored day is after the requested start.

    ``requests`` has the dataset key and ``start`` as ISO text. Days are compared as
    text; a set without stored rows is never refused.
    """
    first = stored.groupBy(*KEY).agg(F.min("timestamp").alias("first_timestamp"))
    first_day = F.date_format("first_timestamp", "yyyy-MM-dd")
    start_day = F.substring("start", 1, 10)
    joined = requests.join(first, list(KEY), "left")
    return joined.select(
        *KEY,
        start_day.alias("start_date"),
        "first_timestamp",
        F.coalesce(first_day > start_day, F.lit(False)).alias("refused"),
    )
