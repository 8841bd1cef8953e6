"""Sliced windows against plain windows, with a key that has most rows."""

import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import ordered, runs


@pytest.fixture(scope="module")
def data(spark):
    ids = spark.range(20_000)
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))
    )
    value = F.when(F.col("id") % 11 != 0, (F.col("id") * 7919) % 1000)
    return ids.select(key.alias("key"), (F.col("id") * 3).alias("at"), value.alias("v")).cache()


@pytest.mark.parametrize("rows", [1 << 20, 1_000, 50])
def test_running_sum_position_and_previous(data, monkeypatch, rows):
    monkeypatch.setattr(ordered, "SLICE_ROWS", rows)
    window = Window.partitionBy("key").orderBy("at")
    upto = window.rowsBetween(Window.unboundedPreceding, 0)
    expected = data.select(
        "key",
        "at",
        F.sum("v").over(upto).alias("total"),
        F.row_number().over(window).cast("long").alias("pos"),
        F.lag("v").over(window).alias("before"),
    )
    got = ordered.running_sum(data, ["key"], "at", F.col("v"), "total")
    got = ordered.position(got, ["key"], "at", "pos")
    got = ordered.previous(got, ["key"], "at", "v", "before", "pos2")
    assert got.where("pos <> pos2 or pos2 is null").count() == 0
    got = got.select("key", "at", "total", "pos", "before")
    assert got.exceptAll(expected).count() == 0
    assert expected.exceptAll(got).count() == 0


@pytest.mark.parametrize("values", ["at", "microseconds of an hour", "far apart"])
def test_slices_divide_a_hot_key(data, monkeypatch, values):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 100)
    at = {
        "at": F.col("at"),
        "microseconds of an hour": F.lit(1_704_067_200_000_000) + F.col("at") * 60_000,
        "far apart": F.pow(F.lit(1.01), F.col("at") % 30_000) * 1e-80,
    }[values]
    sliced = ordered.divide(data.withColumn("at", at), ["key"], "at")
    sizes = sliced.where("key = 'hot'").groupBy("_slice").count()
    assert sizes.count() > 50 and sizes.agg(F.max("count")).first()[0] <= 250
    # Slices follow one another in the order of the values.
    edges = sliced.groupBy("key", "_slice").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    before = F.lag("high").over(Window.partitionBy("key").orderBy("_slice"))
    assert edges.withColumn("before", before).where("before >= low").count() == 0


def test_no_large_key_needs_no_slices(data):
    assert ordered.divide(data, ["key"], "at") is None


def test_slice_numbers(spark, monkeypatch):
    monkeypatch.setattr(ordered, "MOST_SLICES", 9)
    cuts = [float(i * i) for i in range(11)]
    values = [None, float("-inf"), -1.0, 0.0, 0.5, 1.0, 48.9, 49.0, 99.0, 100.0, float("inf"), float("nan")]
    frame = spark.createDataFrame([(cuts, v, i) for i, v in enumerate(values)], "c array<double>, v double, i int")
    number = ordered.slice_number(F.col("c"), F.col("v"))
    got = [r["n"] for r in frame.select("i", number.alias("n")).orderBy("i").collect()]
    assert got == [0, 0, 0, 1, 1, 2, 7, 8, 10, 11, 11, 11]
    assert frame.limit(1).select(ordered.slice_number(F.lit(None).cast("array<double>"), F.lit(1.0))).first()[0] == 0


def test_ends_of_the_order(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 4)
    values = [None, float("-inf"), -2.0, -1.5, 0.0, 1e-300, 1.0, 2.0, 7e15, float("inf"), float("nan")]
    frame = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    got = ordered.position(frame, ["k"], "v", "pos").orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(1, 12))
    assert [str(r["v"]) for r in got] == [str(v) for v in values]


@pytest.mark.parametrize("rows", [10, 1_000])
def test_null_keys_are_one_group(spark, monkeypatch, rows):
    monkeypatch.setattr(ordered, "SLICE_ROWS", rows)
    df = spark.createDataFrame([(None, i) for i in range(100)], "key string, at long")
    got = ordered.position(df, ["key"], "at", "pos")
    assert [r["pos"] for r in got.orderBy("at").collect()] == list(range(1, 101))


@pytest.mark.parametrize("rows", [50, 1 << 20])
def test_exact_median(spark, monkeypatch, rows):
    monkeypatch.setattr(ordered, "SLICE_ROWS", rows)
    values = [((i * 7919) % 997) / 4 for i in range(1501)]
    rows = [("hot", v) for v in values] + [("one", 5.0), ("two", 1.0), ("two", 4.0), ("two", None)]
    rows += [("nan", v) for v in (10.0, 20.0, 30.0, float("nan"))]
    df = spark.createDataFrame(rows, "key string, v double")
    got = {r["key"]: r["median"] for r in runs.exact_median(df, ["key"], "v").collect()}
    want = {"hot": statistics.median(values), "one": 5.0, "two": 2.5, "nan": 25.0}
    assert got == want
