"""Filters, ordering and paging over stored records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.times import bound_literal, check_bound
from tickloom.operators.ordered import slice_number

# Time order is not unique, so these decide among rows with the same time.
TIE_BREAKERS = ("exchange", "symbol", "timeframe", "source")
ORDERS = ("ASC", "DESC")
DEFAULT_LIMIT = 100
# Most rows that one typed read returns.
LARGEST_LIMIT = 10_000
# Pages among so many rows are taken from the top; further down ranges of time are counted.
TOP_ROWS, RANGES = 100_000, 256


def filter_exchange(df: DataFrame, exchange: str | None) -> DataFrame:
    return df.where(F.col("exchange") == exchange) if exchange else df


def filter_symbol(df: DataFrame, symbol: str | None) -> DataFrame:
    """Exact match: ``USDT`` does not select ``BTC/USDT``."""
    return df.where(F.col("symbol") == symbol) if symbol else df


def filter_timeframe(df: DataFrame, timeframe: str | None) -> DataFrame:
    return df.where(F.col("timeframe") == timeframe) if timeframe else df


def filter_time_range(
    df: DataFrame, start: str | None = None, end: str | None = None
) -> DataFrame:
    """``start <= timestamp < end``.

    On stored rows the same bounds are put on the ``date`` partition column, so
    that files of days outside the range are not read.
    """
    dated = "date" in df.columns
    if start:
        df = df.where(F.col("timestamp") >= bound_literal(start, "start"))
        if dated:
            df = df.where(F.col("date") >= check_bound(start, "start")[:10])
    if end:
        df = df.where(F.col("timestamp") < bound_literal(end, "end"))
        if dated:
            df = df.where(F.col("date") <= check_bound(end, "end")[:10])
    return df


def time_order(df: DataFrame, order: str = "DESC") -> list[Column]:
    if order not in ORDERS:
        raise ValueError(f"order must be 'ASC' or 'DESC', got {order!r}")
    stamp = F.col("timestamp")
    ties = [F.col(c) for c in TIE_BREAKERS if c in df.columns]
    return [stamp.desc() if order == "DESC" else stamp.asc(), *ties]


def order_limit(df: DataFrame, order: str = "DESC", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Top rows by time: each task keeps ``limit`` rows, nothing is sorted as a whole."""
    return df.orderBy(*time_order(df, order)).limit(limit)


def check_limit(limit: int) -> int:
    if not 1 <= limit <= LARGEST_LIMIT:
        raise ValueError(f"limit must be between 1 and {LARGEST_LIMIT}, got {limit}")
    return limit


def get_candles(
    candles: DataFrame,
    exchange: str | None = None,
    symbol: str | None = None,
    timeframe: str | None = None,
    start: str | None = None,
    end: str | None = None,
    limit: int = DEFAULT_LIMIT,
    order: str = "DESC",
) -> DataFrame:
    rows = filter_timeframe(
        filter_symbol(filter_exchange(candles, exchange), symbol), timeframe
    )
    return order_limit(filter_time_range(rows, start, end), order, check_limit(limit))


def get_funding_rates(
    rates: DataFrame,
    exchange: str | None = None,
    symbol: str | None = None,
    start: str | None = None,
    end: str | None = None,
    limit: int = DEFAULT_LIMIT,
    order: str = "DESC",
) -> DataFrame:
    rows = filter_symbol(filter_exchange(rates, exchange), symbol)
    return order_limit(filter_time_range(rows, start, end), order, check_limit(limit))


def hide_fake(df: DataFrame) -> DataFrame:
    return df.where(F.col("exchange") != "fake")


def newest_per(df: DataFrame, keys: Sequence[str], oldest: bool = False) -> DataFrame:
    """The latest (or earliest) row per key, by time and then by source.

    An aggregate instead of a window: each map task sends one row per key.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = [c for c in ("timestamp", "source") if c in rest]
    pick = F.min_by if oldest else F.max_by
    best = pick(F.struct(*rest), F.struct(*rank)).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[f"best.{c}" for c in rest])


def page(df: DataFrame, number: int, size: int, order: str = "DESC") -> DataFrame:
    """Rows of a 1-based page in time order.

    Pages among the first ``TOP_ROWS`` rows are taken from the top. For one further down, rows
    are counted per range of time, the ranges being cut at quantiles, and again inside the
    ranges that hold the page, until these have few rows; only they are ordered. So no
    task sees the rows of earlier pages, whatever the page's number.
    """
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    skipped = (number - 1) * size
    if skipped + size > TOP_ROWS:
        df, skipped = around_page(df, skipped, size, order == "DESC")
    return df.orderBy(*time_order(df, order)).offset(skipped).limit(size)


def around_page(
    df: DataFrame, skipped: int, size: int, descending: bool
) -> tuple[DataFrame, int]:
    """Rows of the times of a page, and how many of them come before it.

    Rows without a time have no page here. The driver sees ``RANGES`` counts a round.
    """
    rows = df.where(F.col("timestamp").isNotNull())
    while True:
        micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
        times = rows.select("timestamp", micros.alias("_t"))
        shares = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
        cuts = times.agg(F.percentile_approx("_t", shares, F.lit(10 * RANGES))).first()[0]
        cuts = F.array(*[F.lit(c) for c in sorted(set(cuts or ()))]).cast("array<bigint>")
        counts = times.groupBy(slice_number(cuts, F.col("_t")).alias("_range")).agg(
            F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("low"), F.max("timestamp").alias("high")
        )
        before, kept = 0, []
        ranges = counts.collect()
        for found in sorted(ranges, key=lambda r: r["low"], reverse=descending):
            if before < skipped + size and before + found["n"] > skipped:
                kept.append((before, found))
            before += found["n"]
        if not kept:
            return rows.limit(0), 0
        skipped -= kept[0][0]
        low, high = min(r["low"] for _, r in kept), max(r["high"] for _, r in kept)
        rows = rows.where(F.col("timestamp").between(low, high))
        if "date" in df.columns:
            days = [t.strftime("%Y-%m-%d") for t in (low, high)]
            rows = rows.where(F.col("date").between(*days))
        if len(kept) == len(ranges) or sum(r["n"] for _, r in kept) <= TOP_ROWS:
            return rows, skipped


def page_after(
    df: DataFrame, keys: Sequence[str], last: Sequence, size: int
) -> DataFrame:
    """The page after the row with key values ``last``, ascending by ``keys``.

    The cost does not grow with the depth of the page, unlike an offset.
    """
    beyond, equal = F.lit(False), F.lit(True)
    for key, value in zip(keys, last):
        beyond = beyond | (equal & (F.col(key) > F.lit(value)))
        equal = equal & (F.col(key) == F.lit(value))
    return df.where(beyond).orderBy(*keys).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    """``(rows, pages)``; an empty table has one page."""
    rows = F.count(F.lit(1))
    pages = F.greatest(F.ceil(rows / F.lit(size)), F.lit(1)).cast("long")
    return df.agg(rows.alias("rows"), pages.alias("pages"))


def sample_rows(df: DataFrame, order: Sequence[str], limit: int = 10) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order).limit(limit)


def row_cap(df: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """At most ``limit`` result rows; 0 means all."""
    return df if limit == 0 else df.limit(limit)


def facet_values(
    datasets: DataFrame, exchange: str | None = None, symbol: str | None = None
) -> DataFrame:
    """Distinct exchanges, symbols under an exchange, timeframes under both."""
    under_exchange = filter_exchange(datasets, exchange)
    under_both = filter_symbol(under_exchange, symbol)
    facets = [
        (datasets, "exchange"),
        (under_exchange, "symbol"),
        (under_both.where(F.col("timeframe").isNotNull()), "timeframe"),
    ]
    parts = [
        df.select(F.lit(name).alias("facet"), F.col(name).alias("value")).distinct()
        for df, name in facets
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
