"""How stored records are laid out in folders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.times import iso_text
from tickloom.schemas import CANDLE, RecordKind

DATE = "date"


@dataclass(frozen=True)
class Layout:
    """Hive partition columns per record kind; rows are sorted by the rest of the key."""

    name: str
    candle: tuple[str, ...]
    funding: tuple[str, ...]

    def partitions(self, kind: RecordKind) -> tuple[str, ...]:
        return self.candle if kind is CANDLE else self.funding

    def sort_columns(self, kind: RecordKind) -> list[str]:
        first = list(self.partitions(kind))
        rest = [c for c in ("symbol", "timeframe", "timestamp") if c in kind.fields]
        return first + [c for c in rest if c not in first]


# One folder per market and day. A daily file of one symbol's hourly candles has
# 24 rows, so folders by symbol mean billions of tiny files on a large store. Here
# all symbols of a market share a day's files and are sorted by symbol, so that a
# symbol filter skips row groups by their min/max.
MARKET_DAY = Layout(
    "market_day", candle=("exchange", "timeframe", DATE), funding=("exchange", DATE)
)
# One folder per symbol and day, for stores with few symbols and many point updates.
SYMBOL_DAY = Layout(
    "symbol_day",
    candle=("exchange", "symbol", "timeframe", DATE),
    funding=("exchange", "symbol", DATE),
)


def folder(root: str, kind: RecordKind) -> str:
    return f"{root.rstrip('/')}/{kind.folder}"


def with_date(df: DataFrame) -> DataFrame:
    """Add the record's own day, the last partition column."""
    if isinstance(df.schema["timestamp"].dataType, T.StringType):
        return df.withColumn(DATE, F.substring("timestamp", 1, 10))
    return df.withColumn(DATE, F.substring(iso_text(F.col("timestamp")), 1, 10))


def stored_schema(kind: RecordKind) -> T.StructType:
    return T.StructType([*kind.typed_schema.fields, T.StructField(DATE, T.StringType())])


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
