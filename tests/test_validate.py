from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import as_set, candles, rates
from tickloom.functions import text
from tickloom.operators import validate
from tickloom.operators.validate import batch_verdict, validate_candles, validate_funding
from tickloom.schemas import CANDLE, CANDLE_FIELDS, FUNDING, FUNDING_FIELDS


def codes(issues):
    return sorted((r["record_index"], r["code"], r["field"]) for r in issues.collect())


def test_clean_batches_pass(spark):
    batch = candles(spark, {}, {"timestamp": "2024-01-01T01:00:00"})
    assert codes(validate_candles(batch)) == []
    assert batch_verdict(batch, CANDLE).first().asDict() == {
        "passed": True,
        "errors": 0,
        "issues": 0,
        "records": 2,
    }
    assert codes(validate_funding(rates(spark, {}))) == []


def test_empty_batch_passes(spark):
    verdict = batch_verdict(candles(spark, {}).limit(0), CANDLE).first()
    assert verdict["passed"] and verdict["records"] == 0


def test_every_blank_field_is_reported(spark):
    blanks = ["", " ", "\t", " ", " \n"]
    batch = candles(
        spark, *[{f: blanks[i % len(blanks)]} for i, f in enumerate(CANDLE_FIELDS)]
    )
    found = as_set(
        validate_candles(batch).where(F.col("code") == "EMPTY_FIELD"), "record_index", "field"
    )
    assert found == set(enumerate(CANDLE_FIELDS))
    batch = rates(spark, *[{f: " "} for f in FUNDING_FIELDS])
    found = as_set(
        validate_funding(batch).where(F.col("code") == "EMPTY_FIELD"), "record_index", "field"
    )
    assert found == set(enumerate(FUNDING_FIELDS))


@pytest.mark.parametrize("value", ["abc", "1.2.3", "12,5", "0x10", "", "1.", ".5", "+1", "1e5"])
def test_bad_decimals(spark, value):
    found = codes(validate_candles(candles(spark, {"volume": value})))
    assert (0, "INVALID_DECIMAL", "volume") in found


def test_negative_is_not_invalid(spark):
    assert codes(validate_candles(candles(spark, {"volume": "-5000"}))) == [
        (0, "NEGATIVE_VALUE", "volume")
    ]
    found = codes(validate_candles(candles(spark, {"volume": "-abc"}, {"volume": "-0", "symbol": "b"})))
    assert found == [
        (0, "INVALID_DECIMAL", "volume"),
        (0, "NEGATIVE_VALUE", "volume"),
        (1, "NEGATIVE_VALUE", "volume"),
    ]


def test_precision_warning_does_not_block(spark):
    batch = candles(spark, {"volume": "9" * 39 + ".0"}, {"volume": "9" * 37 + ".9", "symbol": "b"})
    issues = validate_candles(batch)
    assert codes(issues) == [(0, "PRECISION_OVERFLOW", "volume")]
    assert batch_verdict(batch, CANDLE).first()["passed"]
    assert validate.verdict_of_issues(issues).first()["passed"]


def test_storage_checks_block_what_cannot_be_stored(spark):
    batch = candles(
        spark,
        {"volume": "9" * 29},
        {"timestamp": "2024-13-01T00:00:00"},
        {"volume": "0" * 40, "symbol": "c"},
    )
    found = codes(validate.validate(batch, CANDLE, storage=True))
    assert found == [
        (0, "DECIMAL_OUT_OF_RANGE", "volume"),
        (1, "UNPARSEABLE_TIMESTAMP", "timestamp"),
        (2, "PRECISION_OVERFLOW", "volume"),
    ]


@pytest.mark.parametrize("value", ["not-a-date", "2024/01/01T12:00:00", "", "2024-01-01"])
def test_bad_times(spark, value):
    assert (0, "INVALID_TIMESTAMP", "timestamp") in codes(
        validate_candles(candles(spark, {"timestamp": value}))
    )
    found = codes(validate_funding(rates(spark, {"next_funding_time": value})))
    assert (0, "INVALID_TIMESTAMP", "next_funding_time") in found


def test_fraction_and_month_13_have_the_right_shape(spark):
    batch = candles(
        spark, {"timestamp": "2024-01-01T00:00:00.123"}, {"timestamp": "2024-13-01T00:00:00"}
    )
    assert codes(validate_candles(batch)) == []


def test_ohlc_directions(spark):
    batch = candles(
        spark,
        {"high": "10.5"},
        {"high": "9.5", "open": "9.6", "close": "9.4", "symbol": "b"},
        {"low": "10.5", "symbol": "c"},
        {"low": "10.5", "open": "11", "close": "10.1", "symbol": "d"},
    )
    found = [(r["record_index"], r["message"]) for r in validate_candles(batch).collect()]
    assert sorted(found) == [
        (0, "'high' (10.5) is less than 'close' (11)."),
        (1, "'high' (9.5) is less than 'open' (9.6)."),
        (2, "'low' (10.5) exceeds 'open' (10)."),
        (3, "'low' (10.5) exceeds 'close' (10.1)."),
    ]


def test_ohlc_is_skipped_on_bad_or_negative_decimals(spark):
    batch = candles(spark, {"high": "abc"}, {"low": "-100", "open": "-200", "symbol": "b"})
    assert not [c for c in codes(validate_candles(batch)) if c[1] == "OHLC_INVARIANT"]


@pytest.mark.parametrize("value,due", [("0.005", 1), ("-0.005", 1), ("0.00499", 0), ("1.0", 1)])
def test_rate_cap_is_inclusive(spark, value, due):
    issues = validate_funding(rates(spark, {"rate": value}))
    assert codes(issues) == [(0, "FUNDING_RATE_OUT_OF_RANGE", "rate")] * due
    for row in issues.collect():
        assert row["message"] == f"Field 'rate' ({value}) exceeds typical ±0.5% range."


@pytest.mark.parametrize(
    "later,due",
    [("2023-12-31T00:00:00", 1), ("2024-01-01T00:00:00", 1), ("2024-01-01T00:00:01", 0)],
)
def test_next_funding_time_is_after(spark, later, due):
    found = codes(validate_funding(rates(spark, {"next_funding_time": later})))
    assert found == [(0, "FUTURE_BEFORE_CURRENT", "next_funding_time")] * due


def test_duplicates_by_full_key(spark):
    batch = candles(
        spark, {}, {}, {"source": "y"}, {"symbol": "b"}, {"exchange": "z"}, {"timeframe": "4h"}, {}
    )
    issues = validate_candles(batch)
    assert codes(issues) == [
        (1, "DUPLICATE_TIMESTAMP", "timestamp"),
        (6, "DUPLICATE_TIMESTAMP", "timestamp"),
    ]
    assert issues.first()["message"] == (
        "Duplicate timestamp '2024-01-01T00:00:00' for x/BTC/USDT/1h/x."
    )
    assert batch_verdict(batch, CANDLE).first()["errors"] == 2


def test_issue_lines(spark):
    lines = validate.issue_lines(validate_candles(candles(spark, {"volume": "-1"})), CANDLE)
    assert lines.first()["line"] == (
        "[ERROR] NEGATIVE_VALUE candle[0] field=volume: Field 'volume' is negative: '-1'."
    )
    lines = validate.issue_lines(validate_funding(rates(spark, {"rate": "1"})), FUNDING)
    assert lines.first()["line"].startswith("[WARNING] FUNDING_RATE_OUT_OF_RANGE rate[0] field=rate")


def test_a_key_with_a_third_of_all_rows(spark):
    """One key repeated 20,000 times among 60,000 rows."""
    n = 60_000
    hot = F.col("id") % 3 == 0
    rows = spark.range(n).select(
        *[
            F.lit(v).alias(f)
            for f, v in {
                "exchange": "x", "symbol": "s", "timeframe": "1h", "open": "1", "high": "1",
                "low": "1", "close": "1", "volume": "1", "source": "x",
            }.items()
        ],
        F.when(hot, "2024-01-01T00:00:00")
        .otherwise(F.concat(F.lit("2024-01-02T00:00:00."), F.col("id").cast("string")))
        .alias("timestamp"),
        F.col("id").alias("record_index"),
    )
    issues = validate_candles(rows)
    assert issues.count() == n // 3 - 1
    assert issues.where("record_index = 0").count() == 0
    assert batch_verdict(rows, CANDLE).first()["errors"] == n // 3 - 1
    ranked = validate.duplicate_rank(rows, CANDLE).where(hot_key())
    assert ranked.where(F.col("occurrence") != F.col("record_index") / 3 + 1).count() == 0


def hot_key():
    return F.col("timestamp") == "2024-01-01T00:00:00"


digits = st.text("0123456789", min_size=1, max_size=12)
unsigned = st.one_of(digits, st.builds(lambda a, b: f"{a}.{b}", digits, digits))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(unsigned, unsigned), min_size=50, max_size=200))
def test_decimal_order_is_exact(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", text.decimal_gte(F.col("a"), F.col("b")).alias("ge")).collect()
    for row in got:
        assert row["ge"] == (Decimal(row["a"]) >= Decimal(row["b"])), row
