import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import candles
from tickloom.functions import text, times
from tickloom.functions.native import TIMEFRAME_CODES, native_symbol, native_timeframes
from tickloom.operators.cast import display_strings, result_strings, schema_align, typed_cast
from tickloom.schemas import CANDLE


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_typed_cast_cuts_extra_fraction_digits(spark):
    row = typed_cast(candles(spark, {"open": "1.99999999999", "close": "-0"}), CANDLE).first()
    assert row["open"] == Decimal("1.9999999999")
    assert row["timestamp"] == datetime.datetime(2024, 1, 1)
    assert dict(typed_cast(candles(spark, {}), CANDLE).dtypes)["open"] == "decimal(38,10)"


def test_typed_cast_names_the_bad_field(spark):
    with pytest.raises(PySparkException, match="Invalid decimal string 'abc' for high"):
        typed_cast(candles(spark, {"high": "abc"}), CANDLE).collect()


def test_numbers_that_do_not_fit_fail(spark):
    with pytest.raises(PySparkException):
        typed_cast(candles(spark, {"high": "9" * 30}), CANDLE).collect()


def test_resolution(spark):
    rows = candles(spark, {"timestamp": "2024-01-01T00:00:00.25"})
    micro = typed_cast(rows, CANDLE, "us").first()["timestamp"]
    assert micro == datetime.datetime(2024, 1, 1, 0, 0, 0, 250000)
    with pytest.raises(PySparkException, match="fraction of a second"):
        typed_cast(rows, CANDLE).collect()
    assert typed_cast(rows, CANDLE, truncate=True).first()["timestamp"].microsecond == 0
    with pytest.raises(ValueError):
        typed_cast(rows, CANDLE, "ms")


def test_result_strings(spark):
    row = result_strings(typed_cast(candles(spark, {"open": "0.00000001"}), CANDLE)).first()
    assert row["open"] == "0.0000000100"
    assert row["timestamp"] == "2024-01-01T00:00:00"
    assert row["record_index"] == 0


def test_display_strings(spark):
    typed = typed_cast(candles(spark, {"open": "1.50", "volume": "100"}), CANDLE)
    row = display_strings(typed.withColumn("source", F.lit(None).cast("string"))).first()
    assert (row["open"], row["volume"], row["source"]) == ("1.5", "100", "NULL")


def test_schema_align(spark):
    typed = typed_cast(candles(spark, {}), CANDLE)
    older = typed.select(
        *[F.col(c).cast("string").alias(c) for c in reversed(typed.columns)]
    )
    assert schema_align(older, typed.schema).dtypes == typed.dtypes


@pytest.mark.parametrize(
    "value,plain",
    [
        ("1e-08", "0.00000001"),
        ("1.0E-8", "0.00000001"),
        ("1.23456789E7", "12345678.9"),
        ("2E3", "2000"),
        ("42.50", "42.50"),
        ("1e99", "1e99"),
        ("1e-20", "0.00000000000000000001"),
        ("1.2e+21", "1200000000000000000000"),
        ("-1.50e-1", "-0.15"),
        ("-0.0e3", "0"),
        (".5e1", "5"),
        ("e5", "e5"),
    ],
)
def test_plain_decimal(spark, value, plain):
    assert one(spark, text.plain_decimal(F.lit(value))) == plain


def test_only_one_final_newline_may_follow(spark):
    for end, fine in (("", True), ("\n", True), ("\r", False), ("\n\n", False), ("\u0085", False)):
        for value, accepts in (
            ("1.5", text.is_decimal), ("1.5", text.is_unsigned_decimal),
            ("2024-01-01T00:00:00", text.is_iso_time),
        ):
            assert one(spark, accepts(F.lit(value + end))) is fine


def test_small_text_functions(spark):
    assert one(spark, text.day_month_year_to_iso(F.lit("31/12/2024"))) == "2024-12-31"
    assert one(spark, text.day_month_year_to_iso(F.lit("1/12/2024"))) is None
    assert one(spark, text.trim_zeros(F.lit("1.2300"))) == "1.23"
    assert one(spark, text.trim_zeros(F.lit("500"))) == "500"
    assert one(spark, text.digit_count(F.lit("-001.50"))) == 5
    assert one(spark, text.pct_change(F.lit(-2.0), F.lit(1.0))) == 1.5
    assert one(spark, text.pct_change(F.lit(0.0), F.lit(1.0))) is None


def test_times(spark):
    assert one(spark, times.epoch_to_iso(F.lit("1704067200"), "s")) == "2024-01-01T00:00:00"
    assert one(spark, times.epoch_to_iso(F.lit(1704067200999), "ms")) == "2024-01-01T00:00:00"
    assert one(spark, times.epoch_to_iso(F.lit(-1), "ms")) == "1969-12-31T23:59:59"
    assert one(spark, times.iso_to_epoch(F.lit("2024-01-01T00:00:01"))) == 1704067201
    assert one(spark, times.parse_either(F.lit("2024-01-02"))) == datetime.datetime(2024, 1, 2)
    assert one(spark, times.parse_either(F.lit("02.01.2024"))) is None
    with pytest.raises(ValueError):
        times.epoch_to_iso(F.lit(1), "us")


def test_epoch_text_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, times.epoch_to_iso(F.lit(1710054000), "s")) == "2024-03-10T07:00:00"
        assert one(spark, times.epoch_to_iso(F.lit(1710037800), "s")) == "2024-03-10T02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize(
    "exchange,symbol,native",
    [
        ("kucoin", "btc/usdt", "BTC-USDT"),
        ("kucoin", "btc-usdt", "BTC-USDT"),
        ("coinbase", "BTC/USD", "BTC-USD"),
        ("okx", "btc/usdt", "BTC-USDT"),
        ("gateio", "btc/usdt", "BTC_USDT"),
        ("bybit", "btc/usdt", "BTCUSDT"),
        ("mexc", "BTC/USDT", "BTCUSDT"),
        ("gemini", "btc/usd", "BTCUSD"),
        ("bitstamp", "BTC/USD", "btcusd"),
        ("htx", "BTC/USDT", "btcusdt"),
        ("bitfinex", "BTC/USD", "tBTCUSD"),
        ("bitfinex", "tBTCUSD", "tBTCUSD"),
        ("kraken", "BTC/USD", "XBTUSD"),
        ("nowhere", "BTC/USD", None),
    ],
)
def test_native_symbols(spark, exchange, symbol, native):
    assert one(spark, native_symbol(F.lit(exchange), F.lit(symbol))) == native


def test_native_timeframes(spark):
    asked = spark.createDataFrame(
        [("htx", "1h"), ("gateio", "1w"), ("kraken", "3m")], "exchange string, timeframe string"
    )
    found = {r["exchange"]: (r["native"], r["reason"]) for r in native_timeframes(asked).collect()}
    assert found["htx"] == ("60min", None)
    assert found["gateio"] == ("7d", None)
    assert found["kraken"] == (
        None,
        "Unsupported timeframe '3m'. Supported: 15m, 1d, 1h, 1m, 1w, 30m, 4h, 5m",
    )
    assert len(TIMEFRAME_CODES) == 11


def test_every_native_timeframe_has_a_length(spark):
    known = {r["timeframe"] for r in times.timeframe_lengths(spark).collect()}
    used = {code for codes in TIMEFRAME_CODES.values() for code in codes}
    assert used <= known
