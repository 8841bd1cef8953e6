"""Schemas of raw and stored records, issues and run logs, and their natural keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

DECIMAL = T.DecimalType(38, 10)

CANDLE_FIELDS = (
    "exchange",
    "symbol",
    "timeframe",
    "timestamp",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "source",
)
FUNDING_FIELDS = (
    "exchange",
    "symbol",
    "timestamp",
    "rate",
    "predicted_rate",
    "next_funding_time",
    "source",
)


@dataclass(frozen=True)
class RecordKind:
    """What the jobs need to know about one kind of record."""

    name: str
    label: str
    folder: str
    fields: tuple[str, ...]
    decimals: tuple[str, ...]
    times: tuple[str, ...]
    key: tuple[str, ...]

    @property
    def strings(self) -> tuple[str, ...]:
        typed = set(self.decimals) | set(self.times)
        return tuple(f for f in self.fields if f not in typed)

    @property
    def raw_schema(self) -> T.StructType:
        return T.StructType([T.StructField(f, T.StringType(), False) for f in self.fields])

    @property
    def typed_schema(self) -> T.StructType:
        def type_of(field: str) -> T.DataType:
            if field in self.decimals:
                return DECIMAL
            if field in self.times:
                return T.TimestampNTZType()
            return T.StringType()

        return T.StructType([T.StructField(f, type_of(f)) for f in self.fields])


CANDLE = RecordKind(
    name="candle",
    label="candle",
    folder="candles",
    fields=CANDLE_FIELDS,
    decimals=("open", "high", "low", "close", "volume"),
    times=("timestamp",),
    key=("exchange", "symbol", "timeframe", "source", "timestamp"),
)
FUNDING = RecordKind(
    name="funding_rate",
    label="rate",
    folder="funding_rates",
    fields=FUNDING_FIELDS,
    decimals=("rate", "predicted_rate"),
    times=("timestamp", "next_funding_time"),
    key=("exchange", "symbol", "source", "timestamp"),
)

STAGE_STRUCT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("wall_ms", T.DoubleType()),
        T.StructField("cpu_ms", T.DoubleType()),
        T.StructField("mem_delta_mb", T.DoubleType()),
        T.StructField("peak_mb", T.DoubleType()),
        T.StructField("gc_g0", T.LongType()),
        T.StructField("gc_g1", T.LongType()),
        T.StructField("gc_g2", T.LongType()),
        T.StructField("file_kb", T.DoubleType()),
    ]
)
METRIC_STRUCT = T.StructType(
    [
        T.StructField("median", T.DoubleType()),
        T.StructField("ci_lo", T.DoubleType()),
        T.StructField("ci_hi", T.DoubleType()),
    ]
)
RULE_STRUCT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("rating", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)
RUN_LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("runner", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("iterations", T.LongType()),
        T.StructField("ts_resolution", T.StringType()),
        T.StructField("summary", T.MapType(T.StringType(), METRIC_STRUCT)),
        T.StructField("stage_breakdown", T.ArrayType(STAGE_STRUCT)),
        T.StructField("rules", T.ArrayType(RULE_STRUCT)),
        T.StructField("git_sha", T.StringType()),
        T.StructField("git_ref", T.StringType()),
    ]
)
