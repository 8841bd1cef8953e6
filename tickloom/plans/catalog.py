"""Registry of the named queries and the SQL that states their result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans.views import candles, funding, sql_over
from tickloom.schemas import CANDLE, FUNDING
from tickloom.session import configure, shared_dir
from tickloom.sources.sinks import upsert

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query under a name, with its SQL over the given tables if it has one."""

    def register(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(configure(spark), sf_dir)

        QUERIES[name] = Query(configured, sql_over(views, sql) if sql else None)
        return run

    return register


_stores: dict[tuple[str, str], str] = {}


def store(spark: SparkSession, sf_dir: str) -> str:
    """A store with the candles and funding rates of the tables, written once per run."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        root = shared_dir(spark, "store")
        upsert(candles(spark, sf_dir), root, CANDLE, incoming_unique=True)
        upsert(funding(spark, sf_dir), root, FUNDING, incoming_unique=True)
        _stores[key] = root
    return _stores[key]


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') AS {0}"

# Select lists that print typed columns as text.
CANDLE_TEXT = (
    "exchange, symbol, timeframe, "
    + _ISO.format("timestamp")
    + ", "
    + ", ".join(f"CAST({f} AS VARCHAR) AS {f}" for f in CANDLE.decimals)
    + ", source"
)
FUNDING_TEXT = (
    "exchange, symbol, "
    + _ISO.format("timestamp")
    + ", "
    + ", ".join(f"CAST({f} AS VARCHAR) AS {f}" for f in FUNDING.decimals)
    + ", "
    + _ISO.format("next_funding_time")
    + ", source"
)
# The same for text rows, which are stored with ten fraction digits.
STORED_TEXT = (
    "exchange, symbol, timeframe, timestamp, "
    + ", ".join(f"CAST(CAST({f} AS DECIMAL(38,10)) AS VARCHAR) AS {f}" for f in CANDLE.decimals)
    + ", source"
)
STORED_FUNDING_TEXT = (
    "exchange, symbol, timestamp, "
    + ", ".join(f"CAST(CAST({f} AS DECIMAL(38,10)) AS VARCHAR) AS {f}" for f in FUNDING.decimals)
    + ", next_funding_time, source"
)
