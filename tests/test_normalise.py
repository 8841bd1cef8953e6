import json

import pytest
from pyspark.sql import functions as F

from helpers import as_set
from tickloom.operators import normalise
from tickloom.operators.normalise import FORMATS

S, MS = 1704067200, 1704067200000  # 2024-01-01T00:00:00


def pages(spark, *rows):
    """``(exchange, body)`` pages of BTC/USDT 1h."""
    return spark.createDataFrame(
        [(e, "BTC/USDT", "1h", b if isinstance(b, str) else json.dumps(b)) for e, b in rows],
        "exchange string, symbol string, timeframe string, body string",
    )


def parsed_rows(spark, exchange, body, **bounds):
    found = normalise.normalise(pages(spark, (exchange, body)), **bounds)
    return [tuple(r)[3:9] for r in found.orderBy("timestamp").collect()]


def reasons(spark, *rows):
    parsed = normalise.parse_payloads(pages(spark, *rows))
    return [(r["reason"], len(r["rows"])) for r in parsed.collect()]


# Two hours with o=1.5 h=4.5 l=0.5 c=2.5 v=7.5 in every layout.
def values(t, *order):
    known = {"t": t, "o": "1.5", "h": "4.5", "l": "0.5", "c": "2.5", "v": "7.5", "x": "99"}
    return [known[k] for k in order]


def numbers(t, *order):
    return [v if isinstance(v, int) else float(v) for v in values(t, *order)]


def named(t, time, volume, convert):
    return {
        time: t, "open": convert("1.5"), "high": convert("4.5"), "low": convert("0.5"),
        "close": convert("2.5"), volume: convert("7.5"),
    }


def two(make, t, step):
    return [make(t), make(t + step)]


BODIES = {
    "bitfinex": two(lambda t: values(t, *"tochlv"), MS, 3_600_000),
    "bitstamp": {"data": {"ohlc": two(lambda t: named(str(t), "timestamp", "volume", str), S, 3600)}},
    "bybit": {
        "retCode": 0,
        "result": {"list": two(lambda t: values(str(t), *"tohlcvx"), MS, 3_600_000)[::-1]},
    },
    "coinbase": two(lambda t: numbers(t, *"tlhocv"), S, 3600),
    "gateio": two(lambda t: values(str(t), *"tvchlox") + ["false"], S, 3600),
    "gemini": two(lambda t: numbers(t, *"tohlcv"), MS, 3_600_000),
    "htx": {
        "status": "ok",
        "data": two(lambda t: named(t, "id", "amount", float) | {"vol": 9.0, "count": 4}, S, 3600)[::-1],
    },
    "kraken": {
        "error": [],
        "result": {"last": 5, "XXBTZUSD": two(lambda t: values(t, *"tohlcxv") + [8], S, 3600)},
    },
    "kucoin": {"code": "200000", "data": two(lambda t: values(str(t), *"tochlvx"), S, 3600)},
    "mexc": two(lambda t: values(t, *"tohlcv") + [t + 60, "9"], MS, 3_600_000),
    "okx": {
        "code": "0",
        "data": two(lambda t: values(str(t), *"tohlcvxx") + ["1"], MS, 3_600_000)[::-1],
    },
}


def test_every_layout(spark):
    assert set(BODIES) == set(FORMATS)
    found = normalise.normalise(pages(spark, *BODIES.items()))
    expected = {
        (e, "BTC/USDT", "1h", f"2024-01-01T0{h}:00:00", "1.5", "4.5", "0.5", "2.5", "7.5", e)
        for e in FORMATS
        for h in (0, 1)
    }
    assert {tuple(r) for r in found.collect()} == expected
    assert found.count() == 22


def test_positions_ascend_in_time(spark):
    parsed = normalise.parse_payloads(pages(spark, *BODIES.items()))
    found = as_set(normalise.payload_candles(parsed), "exchange", "position", "timestamp")
    assert found == {(e, h, f"2024-01-01T0{h}:00:00") for e in FORMATS for h in (0, 1)}


def test_range_is_half_open_in_either_unit(spark):
    for exchange in ("kraken", "okx"):
        body = BODIES[exchange]
        rows = parsed_rows(spark, exchange, body, start="2024-01-01T01:00:00", end="2024-01-01T02:00")
        assert [r[0] for r in rows] == ["2024-01-01T01:00:00"]
        assert len(parsed_rows(spark, exchange, body, end="2024-01-01T01:00:00")) == 1
        assert parsed_rows(spark, exchange, body, start="2024-01-02") == []


def test_reported_errors(spark):
    bad = [
        ("bitfinex", {"error": "ERR_RATE_LIMIT"}),
        ("bybit", {"retCode": 10001, "result": {}}),
        ("bybit", {"result": {"list": []}}),
        ("coinbase", {"message": "NotFound"}),
        ("gateio", {"label": "INVALID"}),
        ("mexc", {"code": -1121}),
        ("htx", {"status": "error"}),
        ("kraken", {"error": ["EQuery:Unknown asset pair"], "result": {}}),
        ("kucoin", {"code": "400100"}),
        ("okx", {"code": "51001", "data": []}),
        ("kucoin", [1, 2]),
    ]
    assert reasons(spark, *bad) == [("API_ERROR", 0)] * len(bad)


def test_empty_pages(spark):
    empty = [
        ("bitfinex", []),
        ("bitfinex", {"note": "none"}),
        ("bitstamp", {"data": {}}),
        ("bitstamp", {"code": 404}),
        ("bybit", {"retCode": 0, "result": {}}),
        ("gemini", {"result": "error"}),
        ("htx", {"status": "ok"}),
        ("htx", []),
        ("kraken", {"error": [], "result": {"last": 1}}),
        ("kucoin", {"code": "200000"}),
        ("kucoin", {"code": "200000", "data": {}}),
        ("okx", []),
    ]
    assert reasons(spark, *empty) == [(None, 0)] * len(empty)


def test_bad_rows_reject_the_whole_payload(spark):
    good = BODIES["kucoin"]["data"][0]
    bad = [
        ("kucoin", {"code": "200000", "data": [good, good[:3]]}),
        ("kucoin", {"code": "200000", "data": [good, ["soon", *good[1:]]]}),
        ("bitfinex", ["error", 10020, "time: invalid"]),
        ("coinbase", [[S, 1, 2, 3, None, 5]]),
    ]
    assert reasons(spark, *bad) == [("BAD_ROW", 0)] * len(bad)
    assert reasons(spark, ("okx", "<html>"), ("mexc", ""), ("kraken", '{"a":')) == [
        ("INVALID_JSON", 0)
    ] * 3
    assert reasons(spark, ("nowhere", [])) == [("UNKNOWN_EXCHANGE", 0)]


@pytest.mark.parametrize("exchange", sorted(FORMATS))
@pytest.mark.parametrize("stray", [5, "x", None, {"a": 1}])
def test_a_stray_element_rejects_the_page(spark, exchange, stray):
    body = json.loads(json.dumps(BODIES[exchange]))
    rows = body
    while not isinstance(rows, list):
        names = [k for k in rows if k in ("data", "ohlc", "result", "list") or k.startswith("X")]
        rows = rows[names[0]] if names else next(v for v in rows.values() if isinstance(v, list) and v)
    rows.append(stray)
    assert reasons(spark, (exchange, body)) == [("BAD_ROW", 0)]
    outcome = normalise.ingest_outcome(normalise.parse_payloads(pages(spark, (exchange, body))))
    assert not outcome.first()["ok"]


@pytest.mark.parametrize("exchange", sorted(FORMATS))
def test_text_behind_the_body_rejects_it(spark, exchange):
    body = json.dumps(BODIES[exchange])
    close = body[-1]
    rows = [(exchange, body + end) for end in (" trailing", close, close * 2, ",0" + close)]
    assert reasons(spark, *rows) == [("INVALID_JSON", 0)] * len(rows)
    assert reasons(spark, (exchange, f" {body}\n")) == [(None, 2)]


def test_kraken_errors_of_any_shape(spark):
    errors = ["down", {"code": 1}, 7, True, ["E"]]
    got = reasons(spark, *[("kraken", {"error": e, "result": {}}) for e in errors])
    assert got == [("API_ERROR", 0)] * len(errors)
    none = [[], None, "", {}, 0, False]
    assert reasons(spark, *[("kraken", {"error": e, "result": {}}) for e in none]) == [
        (None, 0)
    ] * len(none)


def test_rejects_and_candles_cover_all_payloads(spark):
    rows = [*BODIES.items(), ("okx", "<html>"), ("kucoin", {"code": "1"})]
    parsed = normalise.parse_payloads(pages(spark, *rows))
    assert normalise.payload_rejects(parsed).count() == 2
    outcome = normalise.ingest_outcome(parsed, ["exchange"])
    assert as_set(outcome.where("not ok"), "exchange", "rejected") == {("okx", 1), ("kucoin", 1)}
    assert outcome.agg(F.sum("candles")).first()[0] == 22


def test_small_numbers_become_plain_digits(spark):
    body = f"[[{S}, 0.00000001, 2, 1e-07, 1.5, 12345678.25]]"
    assert parsed_rows(spark, "coinbase", body) == [
        ("2024-01-01T00:00:00", "0.0000001", "2", "0.00000001", "1.5", "12345678.25")
    ]


def test_conformance(spark):
    good, bad = json.dumps(BODIES["okx"]), json.dumps({"code": "1"})
    empty = json.dumps({"code": "0", "data": []})
    rows = [("a", 1, good), ("a", 2, bad), ("a", 3, good), ("a", 4, bad)]
    rows += [("b", 1, bad), ("b", 2, empty), ("b", 3, good)]
    attempts = spark.createDataFrame(
        [("okx", s, "1h", n, b) for s, n, b in rows],
        "exchange string, symbol string, timeframe string, attempt int, body string",
    )
    found = normalise.payload_conformance(attempts, ["symbol"])
    # Only the row listed last is judged.
    rows = BODIES["okx"]["data"]
    odd = [["x"] * len(rows[0]), *rows], [*rows, ["x"] * len(rows[0])]
    pages_of = [("okx", "s", "1h", n + 1, json.dumps({"code": "0", "data": d})) for n, d in enumerate(odd)]
    last = normalise.payload_conformance(spark.createDataFrame(pages_of, attempts.schema), ["symbol"])
    assert as_set(last, "successes", "failures") == {(1, 1)}
    assert as_set(found, "symbol", "successes", "failures", "passed") == {
        ("a", 2, 1, True),
        ("b", 1, 2, False),
    }


@pytest.mark.parametrize(
    "before,after,version,via",
    [
        ("https://a/v1/x", "https://a/v1/x", "unknown", ""),
        ("https://a/v1/x", "https://a/v2/x", "v2", "redirect"),
        ("https://a/v1/x", "https://b/v1/x", "unknown", ""),
        ("https://a/v1/x", "https://a/x", "unknown", "redirect: https://a/v1/x → https://a/x"),
    ],
)
def test_version_drift(spark, before, after, version, via):
    probes = spark.createDataFrame([(before, after)], "requested_url string, final_url string")
    row = normalise.api_version_drift(probes).first()
    assert (row["new_version"], row["detected_via"]) == (version, via)


def test_a_later_payload_replaces_an_earlier_one(spark):
    rows = spark.createDataFrame(
        [("k1", 1, "old", 0), ("k1", 2, "new", 1), ("k2", 1, "a", 2), ("k2", 1, "b", 3)],
        "key string, landed int, value string, n int",
    )
    kept = normalise.latest_payload_wins(rows, ["key"], ["landed"])
    assert as_set(kept, "value") == {("new",), ("a",), ("b",)}
