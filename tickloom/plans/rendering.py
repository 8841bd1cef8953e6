"""Candles written the way each exchange would send them, one page per set and day.

The inverse of the normaliser: input for it, derived from the given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.times import iso_to_epoch
from tickloom.operators.normalise import FORMATS

# A row and its envelope; {s} and {ms} are the time.
TEMPLATES = {
    "bitfinex": ('[{ms},"{open}","{close}","{high}","{low}","{volume}"]', "[{rows}]"),
    "bitstamp": (
        '{"timestamp":"{s}","open":"{open}","high":"{high}","low":"{low}","close":"{close}",'
        '"volume":"{volume}"}',
        '{"data":{"pair":"{symbol}","ohlc":[{rows}]}}',
    ),
    "bybit": (
        '["{ms}","{open}","{high}","{low}","{close}","{volume}","0"]',
        '{"retCode":0,"retMsg":"OK","result":{"list":[{rows}]}}',
    ),
    "coinbase": ("[{s},{low},{high},{open},{close},{volume}]", "[{rows}]"),
    "gateio": (
        '["{s}","{volume}","{close}","{high}","{low}","{open}","0.5","false"]',
        "[{rows}]",
    ),
    "gemini": ("[{ms},{open},{high},{low},{close},{volume}]", "[{rows}]"),
    "htx": (
        '{"id":{s},"open":{open},"close":{close},"low":{low},"high":{high},"amount":{volume},'
        '"vol":1.5,"count":3}',
        '{"status":"ok","data":[{rows}]}',
    ),
    "kraken": (
        '[{s},"{open}","{high}","{low}","{close}","1.5","{volume}",3]',
        '{"error":[],"result":{"XPAIR":[{rows}],"last":0}}',
    ),
    "kucoin": (
        '["{s}","{open}","{close}","{high}","{low}","{volume}","0"]',
        '{"code":"200000","data":[{rows}]}',
    ),
    "mexc": ('[{ms},"{open}","{high}","{low}","{close}","{volume}",{ms},"0"]', "[{rows}]"),
    "okx": (
        '["{ms}","{open}","{high}","{low}","{close}","{volume}","0","0","1"]',
        '{"code":"0","msg":"","data":[{rows}]}',
    ),
}
# Exchanges whose prices are bare JSON numbers.
BARE_NUMBERS = ("coinbase", "gemini", "htx")


def _fill(template: str, values: dict[str, Column]) -> Column:
    parts = re.split(r"\{(\w+)\}", template)
    pieces = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*pieces)


def render(candles: DataFrame, exchange: str) -> DataFrame:
    """``(exchange, symbol, timeframe, day, body)`` pages of candle text rows.

    The original exchange becomes part of the symbol, so that keys stay distinct. A
    page holds the rows of one set and day, at most 24 hourly ones.
    """
    row_template, page_template = TEMPLATES[exchange]
    seconds = iso_to_epoch(F.col("timestamp"))
    values = {c: F.col(c) for c in ("symbol", "open", "high", "low", "close", "volume")}
    values["s"] = seconds.cast("string")
    values["ms"] = (seconds * 1000).cast("string")
    symbol = F.concat_ws(".", "exchange", "symbol")
    rows = candles.withColumn("symbol", symbol).select(
        "symbol",
        "timeframe",
        F.substring("timestamp", 1, 10).alias("day"),
        F.struct(seconds.alias("s"), _fill(row_template, values).alias("row")).alias("item"),
    )
    oldest_first = not FORMATS[exchange].newest_first
    pages = rows.groupBy("symbol", "timeframe", "day").agg(
        F.sort_array(F.collect_list("item"), asc=oldest_first).alias("items")
    )
    listed = F.array_join(F.transform("items", lambda x: x["row"]), ",")
    body = _fill(page_template, {"rows": listed, "symbol": F.col("symbol")})
    return pages.select(
        F.lit(exchange).alias("exchange"), "symbol", "timeframe", "day", body.alias("body")
    )
