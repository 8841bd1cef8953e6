"""Small builders shared by the tests."""

from tickloom.schemas import CANDLE, FUNDING

CANDLE_ROW = {
    "exchange": "x",
    "symbol": "BTC/USDT",
    "timeframe": "1h",
    "timestamp": "2024-01-01T00:00:00",
    "open": "10",
    "high": "12",
    "low": "9",
    "close": "11",
    "volume": "5",
    "source": "x",
}
FUNDING_ROW = {
    "exchange": "x",
    "symbol": "BTC",
    "timestamp": "2024-01-01T00:00:00",
    "rate": "0.0001",
    "predicted_rate": "0.0002",
    "next_funding_time": "2024-01-01T08:00:00",
    "source": "x",
}


def frame(spark, kind, *changes):
    """Rows made of the default record and the given changes, numbered from 0."""
    base = CANDLE_ROW if kind is CANDLE else FUNDING_ROW
    rows = [tuple({**base, **c}[f] for f in kind.fields) + (i,) for i, c in enumerate(changes)]
    names = ", ".join(f"{f} string" for f in kind.fields)
    return spark.createDataFrame(rows, f"{names}, record_index long")


def candles(spark, *changes):
    return frame(spark, CANDLE, *changes)


def rates(spark, *changes):
    return frame(spark, FUNDING, *changes)


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}
