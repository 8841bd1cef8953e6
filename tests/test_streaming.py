import json

import pytest

from helpers import as_set
from tickloom.operators.cast import result_strings
from tickloom.plans.ingest import incremental_backfill
from tickloom.sources import markers, payloads, sinks, store
from tickloom.streaming.follow import follow, follow_since_last
from tickloom.streaming.retries import open_failures, solved_failures

S = 1704067200


def page(*rows):
    return json.dumps(
        {"code": "200000", "data": [[str(S + 3600 * h), "10", c, "12", "9", "5", "0"] for h, c in rows]}
    )


def land(spark, root, *bodies):
    rows = [("kucoin", s, "1h", b) for s, b in bodies]
    frame = spark.createDataFrame(
        rows, "exchange string, symbol string, timeframe string, body string"
    )
    payloads.write_payloads(frame, root)


@pytest.fixture
def feed(spark, tmp_path):
    base = str(tmp_path)

    def run(**options):
        query = follow(
            spark, f"{base}/landing", f"{base}/store", f"{base}/checkpoint", f"{base}/side", **options
        )
        query.awaitTermination()
        assert query.exception() is None

    run.base = base
    run.land = lambda *bodies: land(spark, f"{base}/landing", *bodies)
    run.stored = lambda: {
        (r["symbol"], r["timestamp"][11:13], r["close"][:4])
        for r in result_strings(store.scan_candles(spark, f"{base}/store")).collect()
    }
    return run


def test_follow_corrects_and_resumes(spark, feed):
    feed.land(("A/B", page((0, "11"), (1, "11"))), ("C/D", page((0, "10"))))
    feed()
    assert feed.stored() == {("A/B", "00", "11.0"), ("A/B", "01", "11.0"), ("C/D", "00", "10.0")}
    feed()  # nothing new
    feed.land(("A/B", page((1, "10"), (2, "11"))))
    feed()
    assert feed.stored() == {
        ("A/B", "00", "11.0"), ("A/B", "01", "10.0"), ("A/B", "02", "11.0"), ("C/D", "00", "10.0"),
    }
    log = markers.ingest_log(spark, f"{feed.base}/store")
    assert log.where("symbol = 'A/B'").count() == 2


def test_faulty_symbols_do_not_stop_the_others(spark, feed):
    feed.land(
        ("A/B", page((0, "11"))),
        ("BAD", page((0, "11"), (1, "99"))),
        ("ERR", json.dumps({"code": "400100"})),
        ("DUP", page((0, "11"), (0, "11"))),
    )
    feed(max_files_per_trigger=100)
    assert feed.stored() == {("A/B", "00", "11.0")}
    issues = spark.read.parquet(f"{feed.base}/side/issues")
    assert as_set(issues, "symbol", "code") == {
        ("BAD", "OHLC_INVARIANT"), ("DUP", "DUPLICATE_TIMESTAMP"),
    }
    assert spark.read.parquet(f"{feed.base}/side/records").count() == 4
    rejects = spark.read.parquet(f"{feed.base}/side/rejects")
    assert as_set(rejects, "symbol", "reason") == {("ERR", "API_ERROR")}
    # The corrected page is taken in the next run.
    feed.land(("BAD", page((0, "11"), (1, "10"))))
    feed()
    assert ("BAD", "01", "10.0") in feed.stored()


def test_pages_of_one_trigger_may_overlap(feed):
    feed.land(("A/B", page((0, "10"), (1, "10"))))
    feed.land(("A/B", page((1, "11"), (2, "11"))))
    feed()
    assert {s[1] for s in feed.stored()} == {"00", "01", "02"}


def test_backfill_starts_after_the_stored_rows(spark, tmp_path):
    base = str(tmp_path)
    land(spark, f"{base}/landing", ("A/B", page(*[(h, "10") for h in range(5)])), ("NEW", page((0, "10"))))
    landed = payloads.landed_payloads(spark, f"{base}/landing")
    from helpers import candles

    stored = candles(spark, {"exchange": "kucoin", "source": "kucoin", "symbol": "A/B",
                             "timestamp": "2024-01-01T02:00:00", "close": "12"})
    sinks.write_candles(stored, f"{base}/store")
    asked = landed.select("exchange", "symbol", "timeframe").distinct()
    result = incremental_backfill(spark, asked, landed, f"{base}/store")
    assert result.written == 2
    rows = result_strings(store.scan_candles(spark, f"{base}/store"))
    assert as_set(rows, "symbol", "timestamp", "close") == {
        ("A/B", "2024-01-01T02:00:00", "12.0000000000"),
        ("A/B", "2024-01-01T03:00:00", "10.0000000000"),
        ("A/B", "2024-01-01T04:00:00", "10.0000000000"),
    }


def entries(rows):
    return as_set(rows, "symbol", "reason", "attempts")


def test_held_sets_are_tried_again(spark, feed):
    side = f"{feed.base}/side"
    feed.land(
        ("A/B", page((0, "11"))),
        ("BAD", page((0, "11"), (1, "99"), (2, "10"))),
        ("DUP", page((0, "11"), (0, "11"), (1, "10"))),
        ("ERR", json.dumps({"code": "400100"})),
    )
    feed()
    assert feed.stored() == {("A/B", "00", "11.0")}
    assert entries(open_failures(spark, side)) == {
        ("BAD", "VALIDATION", 1), ("DUP", "VALIDATION", 1), ("ERR", "API_ERROR", 1),
    }
    # Nothing of the failed sets comes: they stay as they are.
    feed.land(("A/B", page((1, "11"))))
    feed()
    assert open_failures(spark, side).where("attempts = 1").count() == 3
    # Another fault, and half of a correction: both fail again, with all they have so far.
    feed.land(("BAD", page((3, "99"))), ("BAD", page((1, "10"))), ("ERR", "[broken"))
    feed()
    assert entries(open_failures(spark, side)) == {
        ("BAD", "VALIDATION", 2), ("DUP", "VALIDATION", 1), ("ERR", "INVALID_JSON", 2),
    }
    assert not {s for s in feed.stored() if s[0] != "A/B"}
    # Corrections of the faulty hours alone complete the sets.
    feed.land(("BAD", page((3, "10"))), ("DUP", page((0, "10"))), ("ERR", page((5, "10"))))
    feed()
    assert {s for s in feed.stored() if s[0] != "A/B"} == {
        ("BAD", "00", "11.0"), ("BAD", "01", "10.0"), ("BAD", "02", "10.0"), ("BAD", "03", "10.0"),
        ("DUP", "00", "10.0"), ("DUP", "01", "10.0"), ("ERR", "05", "10.0"),
    }
    assert open_failures(spark, side).count() == 0
    assert entries(solved_failures(spark, side)) == {
        ("BAD", "VALIDATION", 2), ("DUP", "VALIDATION", 1), ("ERR", "INVALID_JSON", 2),
    }


def test_a_repeated_batch_and_a_new_run_keep_the_ledger(spark, feed):
    from tickloom.streaming.follow import ingest_cycle

    side, root = f"{feed.base}/side", f"{feed.base}/store"
    feed.land(("BAD", page((0, "99"), (1, "10"))))
    landed = payloads.landed_payloads(spark, f"{feed.base}/landing")
    for _ in range(2):
        ingest_cycle(landed, 0, root, side, run="one")
    assert entries(open_failures(spark, side)) == {("BAD", "VALIDATION", 1)}
    feed.land(("BAD", page((0, "11"))))
    fixed = payloads.landed_payloads(spark, f"{feed.base}/landing").where("body LIKE '%11%'")
    # A new run, whose first batch runs twice, takes the open set over.
    for _ in range(2):
        ingest_cycle(fixed, 0, root, side, run="two")
    assert feed.stored() == {("BAD", "00", "11.0"), ("BAD", "01", "10.0")}
    assert open_failures(spark, side).count() == 0
    assert solved_failures(spark, side).count() == 1


def test_since_last_as_a_stream(spark, tmp_path):
    from helpers import candles

    base = str(tmp_path)
    hours = [(h, "10") for h in range(6)]
    for part in (hours[4:], hours[:2], hours[2:4]):
        land(spark, f"{base}/landing", ("A/B", page(*part)), ("NEW", page(*part)))
    stored = candles(spark, {"exchange": "kucoin", "source": "kucoin", "symbol": "A/B",
                             "timestamp": "2024-01-01T02:00:00", "close": "12"})
    sinks.write_candles(stored, f"{base}/store")
    asked = payloads.landed_payloads(spark, f"{base}/landing").select("exchange", "symbol", "timeframe")

    def run():
        query = follow_since_last(
            spark, asked.distinct(), f"{base}/landing", f"{base}/store", f"{base}/checkpoint",
            f"{base}/side", max_files_per_trigger=1,
        )
        query.awaitTermination()
        assert query.exception() is None
        progress = [p for p in query.recentProgress if p["numInputRows"]]
        return sum(p["numInputRows"] for p in progress), len(progress)

    def shown():
        rows = result_strings(store.scan_candles(spark, f"{base}/store"))
        return {(r.symbol, r.timestamp[11:13], r.close[:4]) for r in rows.collect()}

    rows, batches = run()
    assert rows == 6 and batches > 1
    want = {("A/B", "02", "12.0"), ("A/B", "03", "10.0"), ("A/B", "04", "10.0"), ("A/B", "05", "10.0")}
    assert shown() == want
    # The second start reads the one new file, and goes on behind what is stored.
    land(spark, f"{base}/landing", ("A/B", page((5, "11"), (6, "11"))))
    assert run() == (1, 1)
    assert shown() == want | {("A/B", "06", "11.0")}
    assert run() == (0, 0)
