import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import as_set, candles
from tickloom.operators import merge
from tickloom.schemas import CANDLE

KEY = list(CANDLE.key)


def rows(spark, *changes):
    return candles(spark, *changes).drop("record_index")


def hour(h, **values):
    return {"timestamp": f"2024-01-01T{h:02d}:00:00", **values}


def closes(df):
    return sorted((r["timestamp"][11:13], r["close"]) for r in df.collect())


@pytest.mark.parametrize("strategy", merge.STRATEGIES)
def test_cases(spark, strategy):
    stored = rows(spark, hour(0), hour(1), hour(2, close="9.5"))
    # identical
    assert closes(merge.merge(stored, stored, KEY, strategy)) == closes(stored)
    # new
    new = rows(spark, hour(5))
    assert len(closes(merge.merge(stored, new, KEY, strategy))) == 4
    # updated, mixed
    mixed = rows(spark, hour(2, close="10.5"), hour(3), hour(0))
    assert closes(merge.merge(stored, mixed, KEY, strategy)) == [
        ("00", "11"),
        ("01", "11"),
        ("02", "10.5"),
        ("03", "11"),
    ]
    # empty sides
    nothing = stored.limit(0)
    assert closes(merge.merge(nothing, mixed, KEY, strategy)) == closes(mixed)
    assert closes(merge.merge(stored, nothing, KEY, strategy)) == closes(stored)


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="strategy"):
        merge.merge(rows(spark, {}), rows(spark, {}), KEY, "fast")


def test_change_log(spark):
    stored = rows(spark, hour(0), hour(1), hour(2))
    incoming = rows(spark, hour(0), hour(1, close="10"), hour(7))
    found = dict(as_set(merge.merge_change_log(stored, incoming, KEY), "action", "rows"))
    assert found == {"unchanged": 1, "update": 1, "insert": 1, "keep": 1}


def test_null_keys_and_values_match(spark):
    stored = rows(spark, {}).withColumns(
        {"source": F.lit(None).cast("string"), "close": F.lit(None).cast("string")}
    )
    found = dict(as_set(merge.merge_change_log(stored, stored, KEY), "action", "rows"))
    assert found == {"unchanged": 1}


def test_upsert_keeps_all_incoming_copies(spark):
    stored, incoming = rows(spark, hour(0), hour(1)), rows(spark, hour(1), hour(1), hour(2))
    assert merge.upsert_merge(stored, incoming, KEY).count() == 4


def test_changes_refuse_repeated_keys(spark):
    with pytest.raises(PySparkException, match="more than once"):
        merge.change_merge(rows(spark, hour(0)), rows(spark, hour(1), hour(1)), KEY).collect()


def test_hot_incoming_key(spark):
    """A third of the incoming rows has one key, and so have many stored rows."""
    def many(n, close):
        base = rows(spark, {})
        time = F.when(F.col("id") % 3 == 0, "2024-01-01T00:00:00").otherwise(
            F.concat(F.lit("2024-01-02T00:00:00."), F.col("id").cast("string"))
        )
        return (
            spark.range(n)
            .select(time.alias("timestamp"), F.lit(close).alias("close"))
            .join(F.broadcast(base.drop("timestamp", "close")), F.lit(True))
            .select(*CANDLE.fields)
        )

    stored, incoming = many(9_000, "1"), many(3_000, "2")
    merged = merge.upsert_merge(stored, incoming, KEY)
    counts = dict(as_set(merged.groupBy("close").count(), "close", "count"))
    assert counts == {"2": 3_000, "1": 4_000}


cents = st.integers(0, 10_000).map(lambda c: f"{c // 100}.{c % 100:02d}")
batches = st.dictionaries(st.integers(0, 23), cents, max_size=20)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(batches, batches)
def test_properties(spark, stored, incoming):
    def table(batch):
        changes = [hour(h, close=c) for h, c in batch.items()]
        return rows(spark, *changes) if changes else rows(spark, {}).limit(0)

    a, b = table(stored), table(incoming)
    expected = sorted((f"{h:02d}", c) for h, c in {**stored, **incoming}.items())
    once = merge.upsert_merge(a, b, KEY)
    assert closes(once) == expected
    assert closes(merge.change_merge(a, b, KEY)) == expected
    assert closes(merge.upsert_merge(once, b, KEY)) == expected
