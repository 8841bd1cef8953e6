"""Raw text records <-> typed records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.text import cut_fraction, is_decimal, plain_decimal, trim_zeros
from tickloom.functions.times import iso_text
from tickloom.schemas import RecordKind

_STORED_DECIMAL = "decimal(38,10)"


def decimal_of(value: Column, label: str) -> Column:
    """Text -> ``decimal(38,10)``; extra fraction digits are cut, not rounded.

    Text that is no decimal fails the job with its label; so does a number that
    does not fit, since the cast runs in ANSI mode.
    """
    message = F.concat(F.lit("Invalid decimal string '"), value, F.lit(f"' for {label}"))
    return F.when(is_decimal(value), cut_fraction(value).cast(_STORED_DECIMAL)).otherwise(
        F.raise_error(message).cast(_STORED_DECIMAL)
    )


def time_of(value: Column, resolution: str, truncate: bool) -> Column:
    """ISO text -> zone-free timestamp, to the second (``s``) or microsecond (``us``)."""
    if resolution not in ("s", "us"):
        raise ValueError(f"Invalid timestamp resolution: {resolution}")
    stamp = value.cast("timestamp_ntz")
    if resolution == "us":
        return stamp
    whole = F.regexp_replace(value, r"\.[0-9]+$", "").cast("timestamp_ntz")
    if truncate:
        return whole
    message = F.concat(F.lit("Timestamp has a fraction of a second: "), value)
    return F.when(stamp == whole, whole).otherwise(F.raise_error(message).cast("timestamp_ntz"))


def typed_cast(
    raw: DataFrame, kind: RecordKind, resolution: str = "s", truncate: bool = False
) -> DataFrame:
    """Canonical text rows -> the stored schema, keeping any extra columns."""

    def convert(field: str) -> Column:
        if field in kind.decimals:
            return decimal_of(F.col(field), field).alias(field)
        if field in kind.times:
            return time_of(F.col(field), resolution, truncate).alias(field)
        return F.col(field)

    extra = [c for c in raw.columns if c not in kind.fields]
    return raw.select(*[convert(f) for f in kind.fields], *extra)


def schema_align(stored: DataFrame, schema: T.StructType) -> DataFrame:
    """Stored rows in the column order and types of ``schema``."""
    return stored.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def result_strings(df: DataFrame) -> DataFrame:
    """Decimals as plain text and timestamps as ISO text; the rest unchanged."""

    def convert(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            return column.cast("string").alias(field.name)
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            return iso_text(column).alias(field.name)
        return column

    return df.select(*[convert(f) for f in df.schema])


def display_strings(df: DataFrame) -> DataFrame:
    """Every column as text for a listing: no trailing zeros, ``NULL`` for null."""
    texts = result_strings(df)
    return texts.select(
        *[
            F.coalesce(trim_zeros(F.col(f"`{c}`").cast("string")), F.lit("NULL")).alias(c)
            for c in texts.columns
        ]
    )


def normalise_decimals(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Expand exponents in the given text columns."""
    return df.withColumns({f: plain_decimal(F.col(f)) for f in fields})
