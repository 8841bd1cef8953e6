"""The catalogue of datasets against recounts of the store."""

import os
import random

import pytest

from helpers import as_set, candles, rates
from tickloom.operators import summary
from tickloom.operators.merge import CHANGES, UPSERT
from tickloom.plans.sql import raw_sql
from tickloom.schemas import CANDLE, FUNDING
from tickloom.sources import catalogue, store
from tickloom.sources.layout import MARKET_DAY, SYMBOL_DAY, folder
from tickloom.sources.sinks import upsert, write_candles, write_funding

KEY = ("exchange", "symbol", "timeframe", "files", "rows")


def recount(spark, root, kind):
    found = store.scan(spark, root, kind)
    counts = catalogue._counts(found, kind, 1)
    return as_set(counts.where("NOT total"), *KEY)


def known(spark, root, kind=CANDLE):
    return as_set(catalogue.known_datasets(spark, root, kind), *KEY)


def batch(spark, pick, n=12):
    keys = {(pick.choice("AB"), pick.choice(["1h", "4h"]), pick.randrange(1, 6), pick.randrange(24))
            for _ in range(n)}
    return candles(spark, *[
        {"symbol": s, "timeframe": t, "timestamp": f"2024-01-0{d}T{h:02d}:00:00",
         "close": str(pick.randrange(9, 13))}
        for s, t, d, h in keys
    ])


@pytest.mark.parametrize("layout", [MARKET_DAY, SYMBOL_DAY])
def test_equals_a_recount_after_mixed_writes(spark, tmp_path, monkeypatch, layout):
    monkeypatch.setattr(catalogue, "COMPACT_AFTER", 4)
    pick, root = random.Random(layout.name), str(tmp_path)
    for i in range(10):
        write_candles(
            batch(spark, pick), root, layout=layout, strategy=CHANGES if i % 3 else UPSERT
        )
        if i % 3 == 0:
            assert known(spark, root) == recount(spark, root, CANDLE)
    assert known(spark, root) == recount(spark, root, CANDLE)
    names = os.listdir(f"{root}/_catalogue/{CANDLE.folder}")
    assert len([n for n in names if not n.startswith(".")]) <= 5
    write_funding(rates(spark, {}, {"symbol": "ETH"}), root)
    assert known(spark, root, FUNDING) == recount(spark, root, FUNDING)


def test_answers_without_reading_the_store(spark, tmp_path):
    root = str(tmp_path)
    write_candles(candles(spark, {}, {"symbol": "B"}), root)
    for path, _, names in os.walk(folder(root, CANDLE)):
        for name in names:
            if name.endswith(".parquet"):
                with open(f"{path}/{name}", "wb") as file:
                    file.write(b"no parquet")
    found = summary.dataset_summary(spark, root)
    assert as_set(found, *KEY) == {("x", "BTC/USDT", "1h", 1, 1), ("x", "B", "1h", 1, 1)}
    rows = raw_sql(spark, "SELECT symbol FROM dataset_summary", root)
    assert as_set(rows, "symbol") == {("BTC/USDT",), ("B",)}


def test_a_died_write_makes_it_unknown_until_the_next(spark, tmp_path, monkeypatch):
    from tickloom.sources import sinks

    root = str(tmp_path)
    write_candles(candles(spark, {}), root)
    write = sinks.write_partitions

    def died(*args):
        write(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(sinks, "write_partitions", died)
    with pytest.raises(RuntimeError):
        write_candles(candles(spark, {"symbol": "B"}), root)
    monkeypatch.undo()
    assert catalogue.known_datasets(spark, root, CANDLE) is None
    assert as_set(summary.dataset_summary(spark, root), *KEY) == recount(spark, root, CANDLE)
    write_candles(candles(spark, {"symbol": "C"}), root)
    assert len(known(spark, root)) == 3 and known(spark, root) == recount(spark, root, CANDLE)


def test_files_of_others_make_it_unknown(spark, tmp_path):
    root = str(tmp_path)
    write_candles(candles(spark, {}), root)
    extra = store.scan_candles(spark, root).drop("exchange", "timeframe", "date")
    day = f"{folder(root, CANDLE)}/exchange=x/timeframe=1h/date=2024-02-01"
    extra.write.parquet(day)
    assert catalogue.known_datasets(spark, root, CANDLE) is None
    catalogue.refresh_catalogue(spark, root, CANDLE)
    assert known(spark, root) == {("x", "BTC/USDT", "1h", 2, 2)}


def test_a_store_without_a_catalogue_gets_one(spark, tmp_path):
    import shutil

    root = str(tmp_path)
    write_candles(candles(spark, {}), root)
    shutil.rmtree(f"{root}/_catalogue")
    assert catalogue.known_datasets(spark, root, CANDLE) is None
    upsert(candles(spark, {"symbol": "B"}), root, CANDLE)
    assert known(spark, root) == recount(spark, root, CANDLE)
