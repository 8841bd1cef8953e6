import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helpers import as_set, candles, rates
from tickloom.operators import coverage, select, summary
from tickloom.operators.cast import result_strings, typed_cast
from tickloom.operators.merge import CHANGES, UPSERT
from tickloom.plans.ingest import IngestRejected, validated_ingest
from tickloom.schemas import CANDLE, CANDLE_FIELDS, FUNDING
from tickloom.sources import markers, sinks, store
from tickloom.sources.layout import MARKET_DAY, SYMBOL_DAY, folder


def at(day, hour=0, **values):
    return {"timestamp": f"2024-01-{day:02d}T{hour:02d}:00:00", **values}


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


@pytest.mark.parametrize("layout", [MARKET_DAY, SYMBOL_DAY])
@pytest.mark.parametrize("strategy", [UPSERT, CHANGES])
def test_round_trip_is_idempotent_and_corrects(spark, root, layout, strategy):
    options = {"layout": layout, "strategy": strategy}
    batch = candles(spark, at(1), at(1, 1), at(2), at(2, symbol="a:b/c%d"))
    sinks.write_candles(batch, root, **options)
    first = result_strings(store.scan_candles(spark, root)).collect()
    sinks.write_candles(batch, root, **options)
    assert sorted(result_strings(store.scan_candles(spark, root)).collect()) == sorted(first)
    assert {r["symbol"] for r in first} == {"BTC/USDT", "a:b/c%d"}

    written = sinks.write_candles(candles(spark, at(2, close="10"), at(3)), root, **options)
    assert as_set(written, "date") == {("2024-01-02",), ("2024-01-03",)}
    rows = store.scan_candles(spark, root)
    assert rows.count() == 5
    changed = rows.where("date = '2024-01-02' and symbol = 'BTC/USDT'").first()
    assert str(changed["close"]) == "10.0000000000"
    wrong = rows.where(F.col("date") != F.date_format("timestamp", "yyyy-MM-dd"))
    assert wrong.count() == 0


def test_only_changed_partitions_are_rewritten(spark, root):
    sinks.write_candles(candles(spark, at(1), at(2), at(3)), root)
    before = as_set(store.list_files(spark, root), "path")
    batch = candles(spark, at(1), at(2, close="10"))
    written = sinks.write_candles(batch, root, strategy=CHANGES)
    assert as_set(written, "date") == {("2024-01-02",)}
    after = as_set(store.list_files(spark, root), "path")
    assert len(before & after) == 2 and len(after) == 3
    assert sinks.write_candles(batch, root, strategy=CHANGES).count() == 0
    assert as_set(store.list_files(spark, root), "path") == after


def test_many_partitions(spark, root):
    """The changed partitions are returned, also where there are many of them."""
    days = spark.range(620).select(
        F.date_format(F.expr("date_add(DATE '2024-01-01', CAST(id AS INT))"), "yyyy-MM-dd").alias("d")
    )
    base = candles(spark, {}).drop("timestamp", "record_index").crossJoin(F.broadcast(days))
    first = base.withColumn("timestamp", F.concat("d", F.lit("T00:00:00")))
    sinks.write_candles(first, root)
    again = first.withColumn("close", F.when(F.col("d") < "2025-06-04", "10").otherwise(F.col("close")))
    written = sinks.write_candles(again, root, strategy=CHANGES)
    assert written.count() == 520
    assert written.agg(F.max("date")).first()[0] == "2025-06-03"
    rows = store.scan_candles(spark, root)
    assert (rows.count(), rows.where("close = 10").count()) == (620, 520)


def test_empty_batch_writes_nothing(spark, root):
    assert sinks.write_candles(candles(spark, {}).limit(0), root).count() == 0
    assert store.scan_candles(spark, root).count() == 0


def test_funding(spark, root):
    sinks.write_funding(rates(spark, at(1), at(1, symbol="ETH", rate="-0.0002")), root)
    sinks.write_funding(rates(spark, at(1, rate="0.0003")), root)
    found = as_set(result_strings(store.scan_funding(spark, root)), "symbol", "rate")
    assert found == {("BTC", "0.0003000000"), ("ETH", "-0.0002000000")}


def test_bad_options(spark, root):
    with pytest.raises(ValueError, match="strategy"):
        sinks.write_candles(candles(spark, {}), root, strategy="fast")


# --- gate ------------------------------------------------------------------------


def test_an_error_blocks_the_whole_batch(spark, root):
    batch = candles(spark, at(1), at(2, volume="-1"))
    with pytest.raises(IngestRejected, match=r"1 issue\(s\); no data written"):
        validated_ingest(batch, root, CANDLE)
    assert store.scan_candles(spark, root).count() == 0


def test_warnings_do_not_block(spark, root):
    result = validated_ingest(rates(spark, at(1, rate="0.01")), root, FUNDING)
    assert (result.written, result.held_back, result.issues) == (1, 0, 1)


def test_scope_and_quarantine(spark, root, tmp_path):
    batch = candles(spark, at(1), at(2, symbol="bad", volume="x"), at(3, symbol="bad"))
    side = str(tmp_path / "side")
    for _ in range(2):  # a batch that runs again leaves the same side tables
        result = validated_ingest(
            batch, root, CANDLE, scope=["symbol"], quarantine=side, batch_id=7, mark=True,
            run="nightly",
        )
        assert (result.written, result.held_back) == (1, 2)
        assert as_set(store.scan_candles(spark, root), "symbol") == {("BTC/USDT",)}
        assert spark.read.parquet(f"{side}/records").count() == 2
        assert as_set(spark.read.parquet(f"{side}/issues"), "code", "symbol") == {
            ("INVALID_DECIMAL", "bad")
        }
    log = markers.ingest_log(spark, root)
    assert as_set(log, "provider", "symbol", "records") == {("x", "BTC/USDT", 1)}
    assert log.count() == 1
    assert markers.last_ingest(spark, root).first()[0] <= datetime.datetime.now()


def test_calls_without_a_run_keep_each_others_records(spark, root, tmp_path):
    side = str(tmp_path / "side")
    for day in (1, 2):
        validated_ingest(candles(spark, at(day, volume="x")), root, CANDLE, quarantine=side)
    held = spark.read.parquet(f"{side}/records")
    assert as_set(held, "timestamp") == {("2024-01-01T00:00:00",), ("2024-01-02T00:00:00",)}


def test_fraction_of_a_second_is_held_back(spark, root, tmp_path):
    side = str(tmp_path / "side")
    odd = at(2, symbol="bad") | {"timestamp": "2024-01-02T00:00:00.5"}
    even = at(3, symbol="ok") | {"timestamp": "2024-01-03T00:00:00.000"}
    batch = candles(spark, at(1), odd, even)
    result = validated_ingest(batch, root, CANDLE, scope=["symbol"], quarantine=side)
    assert (result.written, result.held_back) == (2, 1)
    codes = as_set(spark.read.parquet(f"{side}/issues"), "code", "field")
    assert codes == {("FRACTION_OF_SECOND", "timestamp")}
    whole = validated_ingest(batch, root, CANDLE, resolution="us")
    assert whole.written == 3


def test_quarantine_without_scope_holds_everything(spark, root, tmp_path):
    batch = candles(spark, at(1), at(2, volume="x"))
    result = validated_ingest(batch, root, CANDLE, quarantine=str(tmp_path / "side"))
    assert (result.written, result.held_back) == (0, 2)
    assert store.scan_candles(spark, root).count() == 0


def test_no_marker_yet(spark, root):
    assert markers.last_ingest(spark, root).first()[0] is None


# --- queries ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("small"))
    rows = [at(1, h) for h in range(3)] + [at(2, h) for h in range(2)]
    rows += [at(1, symbol="ETH/USDT"), at(1, exchange="y", timeframe="4h"), at(1, exchange="fake")]
    sinks.write_candles(candles(spark, *rows), root)
    sinks.write_funding(rates(spark, at(1), at(2, symbol="ETH")), root)
    return root


def test_filters(spark, small):
    rows = store.scan_candles(spark, small)
    assert select.get_candles(rows, exchange="x").count() == 6
    assert select.get_candles(rows, symbol="USDT").count() == 0
    assert select.get_candles(rows, symbol="ETH/USDT", exchange="x").count() == 1
    assert select.get_candles(rows, timeframe="4h").count() == 1
    ranged = select.get_candles(
        rows, exchange="x", symbol="BTC/USDT", start="2024-01-01T01:00", end="2024-01-02T01:00:00"
    )
    assert [r["timestamp"].hour for r in ranged.collect()] == [0, 2, 1]
    newest = select.get_candles(rows, exchange="x", limit=1).first()
    assert newest["timestamp"] == datetime.datetime(2024, 1, 2, 1)
    for limit in (0, 10_001):
        with pytest.raises(ValueError, match="limit"):
            select.get_candles(rows, limit=limit)
    oldest = select.get_candles(rows, exchange="x", limit=1, order="ASC").first()
    assert oldest["timestamp"] == datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "bound", ["2024", "2024-01-01' OR 1=1", "2024-01-01 00:00:00", "now()", "2024-01-01T00:00:00Z"]
)
def test_bounds_are_checked(spark, small, bound):
    with pytest.raises(ValueError, match="ISO-8601"):
        select.get_candles(store.scan_candles(spark, small), start=bound)


@pytest.mark.parametrize("order", ["desc", "ASC; DROP", ""])
def test_order_is_checked(spark, small, order):
    with pytest.raises(ValueError, match="order"):
        select.get_candles(store.scan_candles(spark, small), order=order)


def test_plan_prunes_days_and_columns_and_keeps_a_top_n(spark, small):
    rows = store.scan_candles(spark, small)
    query = select.get_candles(rows, exchange="x", symbol="BTC/USDT", start="2024-01-02")
    plan = query.select("timestamp", "close")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    partition_filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "date" in partition_filters and "exchange" in partition_filters
    pushed = plan.split("PushedFilters: [")[1].split("ReadSchema")[0]
    assert "GreaterThanOrEqual(timestamp" in pushed and "EqualTo(symbol" in pushed
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "close" in schema and "volume" not in schema


def test_summary_and_listing(spark, small):
    found = as_set(summary.dataset_summary(spark, small), *summary.DATASET, "files", "rows")
    assert found == {
        ("candle", "x", "BTC/USDT", "1h", 2, 5),
        ("candle", "x", "ETH/USDT", "1h", 1, 1),
        ("candle", "y", "BTC/USDT", "4h", 1, 1),
        ("candle", "fake", "BTC/USDT", "1h", 1, 1),
        ("funding_rate", "x", "BTC", None, 1, 1),
        ("funding_rate", "x", "ETH", None, 1, 1),
    }
    names = summary.list_datasets(store.discover_datasets(spark, small))
    assert as_set(names, "type", "dataset") == {
        ("candle", "x/BTC/USDT/1h"),
        ("candle", "x/ETH/USDT/1h"),
        ("candle", "y/BTC/USDT/4h"),
        ("funding_rate", "x/BTC/funding_rate"),
        ("funding_rate", "x/ETH/funding_rate"),
    }


def test_a_broken_file_does_not_hide_the_others(spark, root):
    sinks.write_candles(candles(spark, at(1), at(2, exchange="y")), root)
    broken = folder(root, CANDLE) + "/exchange=z/timeframe=1h/date=2024-01-01"
    import pathlib

    pathlib.Path(broken).mkdir(parents=True)
    pathlib.Path(broken, "part.parquet").write_bytes(b"PAR1 not parquet")
    # The broken file is counted under what its folders tell.
    found = as_set(summary.dataset_summary(spark, root), "exchange", "symbol", "timeframe", "files", "rows")
    broken = {row for row in found if row[1] is None}
    assert found - broken == {("x", "BTC/USDT", "1h", 1, 1), ("y", "BTC/USDT", "1h", 1, 1)}
    assert len(broken) == 1 and next(iter(broken))[2:] == ("1h", 1, 0)


def test_listing_summary_shows_unreadable_datasets_as_zero(spark):
    files = spark.createDataFrame(
        [("r/x/BTC/USDT/1h/a.parquet",), ("r/x/ETH/1h/a.parquet",), ("r/a.parquet",)], "path string"
    )
    listing = store.discover_plain(files.withColumn("path", F.concat(F.lit("/"), "path")), "/r")
    counts = spark.createDataFrame(
        [("candle", "x", "BTC/USDT", "1h", 5)],
        "type string, exchange string, symbol string, timeframe string, rows long",
    )
    found = as_set(summary.listing_summary(listing, counts), "symbol", "files", "rows")
    assert found == {("BTC/USDT", 1, 5), ("ETH", 1, 0)}


def test_empty_store(spark, root):
    assert summary.dataset_summary(spark, root).count() == 0
    assert store.discover_datasets(spark, root).count() == 0
    assert select.get_candles(store.scan_candles(spark, root)).count() == 0


def test_facets(spark, small):
    found = summary.dataset_summary(spark, small).where("type = 'candle'")
    facets = as_set(select.facet_values(found, "x", "ETH/USDT"), "facet", "value")
    assert facets == {
        ("exchange", "x"), ("exchange", "y"), ("exchange", "fake"),
        ("symbol", "BTC/USDT"), ("symbol", "ETH/USDT"), ("timeframe", "1h"),
    }


def test_column_stats(spark, small):
    rows = store.scan_candles(spark, small).withColumn("open", F.when(F.col("exchange") != "y", F.col("open")))
    stats = {r["name"]: r for r in summary.column_stats(rows.drop("date")).collect()}
    assert list(stats) == list(CANDLE_FIELDS)
    assert (stats["open"]["nulls"], stats["open"]["min"]) == (1, "10.0000000000")
    assert stats["symbol"]["min"] is None


def test_paging(spark, small):
    rows = store.scan_candles(spark, small)
    seen = [select.page(rows, n, 3).collect() for n in (1, 2, 3, 4)]
    assert [len(p) for p in seen] == [3, 3, 2, 0]
    assert len({r for p in seen for r in p}) == 8
    assert select.page_count(rows, 3).first().asDict() == {"rows": 8, "pages": 3}
    assert select.page_count(rows.limit(0), 3).first()["pages"] == 1
    keys = ["timestamp", "exchange", "symbol"]
    first = select.page_after(rows, keys, [F.lit("2000-01-01").cast("timestamp_ntz"), "", ""], 5)
    last = first.collect()[-1]
    rest = select.page_after(rows, keys, [last[k] for k in keys], 100)
    assert rest.count() == 3
    with pytest.raises(ValueError):
        select.page(rows, 0, 5)


def test_resume_points(spark, small):
    asked = spark.createDataFrame(
        [("x", "BTC/USDT", "1h"), ("x", "NEW", "1h"), ("x", "BTC/USDT", "1M")],
        "exchange string, symbol string, timeframe string",
    )
    points = coverage.resume_points(asked, store.scan_candles(spark, small)).collect()
    found = {(r["symbol"], r["timeframe"]): (r["start"], r["problem"]) for r in points}
    assert found == {
        ("BTC/USDT", "1h"): (datetime.datetime(2024, 1, 2, 2), None),
        ("NEW", "1h"): (None, "no stored data"),
        ("BTC/USDT", "1M"): (None, "unknown timeframe"),
    }


def test_coverage(spark, small):
    asked = spark.createDataFrame(
        [
            ("x", "BTC/USDT", "1h", "2023-12-31"),
            ("x", "ETH/USDT", "1h", "2024-01-01T12:00:00"),
            ("x", "NEW", "1h", "2020-01-01"),
        ],
        "exchange string, symbol string, timeframe string, start string",
    )
    found = coverage.coverage_check(asked, store.scan_candles(spark, small))
    assert as_set(found, "symbol", "refused") == {
        ("BTC/USDT", True), ("ETH/USDT", False), ("NEW", False),
    }


# --- inspect ---------------------------------------------------------------------


def plain_file(path, hours):
    start = datetime.datetime(2024, 1, 1)
    times = [start + datetime.timedelta(hours=h) for h in hours]
    table = pa.table(
        {
            "symbol": ["BTC/USDT"] * len(times),
            "timestamp": pa.array(times, pa.timestamp("s")),
            "open": pa.array([str(h) for h in hours]).cast(pa.decimal128(38, 10)),
        }
    )
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(table, path, row_group_size=4)


def test_inspect_reads_files_and_trees(spark, tmp_path):
    plain_file(tmp_path / "x/BTC/USDT/1h/2024-01-01.parquet", range(6))
    plain_file(tmp_path / "x/BTC/USDT/1h/2024-01-02.parquet", range(24, 30))
    (tmp_path / "notes.txt").write_text("no table")
    tree = str(tmp_path)
    assert store.inspect_scan(spark, tree).count() == 12
    assert store.inspect_scan(spark, tree, "2024-01-01T04:00:00", "2024-01-02T01:00:00").count() == 3
    single = str(tmp_path / "x/BTC/USDT/1h/2024-01-01.parquet")
    assert store.inspect_scan(spark, single, end="2024-01-01T02:00:00").count() == 2
    listing = store.discover_plain(store.list_files(spark, tree), tree)
    assert as_set(listing, *summary.DATASET) == {("candle", "x", "BTC/USDT", "1h")}
    groups = store.file_footers(spark, tree).orderBy("path", "row_group").collect()
    assert [(r["file_rows"], r["row_groups"], r["row_group"], r["rows"]) for r in groups] == [
        (6, 2, 0, 4), (6, 2, 1, 2), (6, 2, 0, 4), (6, 2, 1, 2),
    ]
    assert {r["compression"] for r in groups} == {"SNAPPY"} and groups[0]["columns"] == 3


def test_inspect_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.inspect_scan(spark, str(tmp_path / "missing"))
    (tmp_path / "a.csv").write_text("x")
    with pytest.raises(ValueError, match="Not a parquet file"):
        store.inspect_scan(spark, str(tmp_path / "a.csv"))
    with pytest.raises(ValueError, match="No parquet files"):
        store.inspect_scan(spark, str(tmp_path))


def test_charts(spark):
    from tickloom.operators import charts

    rows = typed_cast(
        candles(
            spark,
            {"timestamp": "2024-01-01T00:00:00.5", "source": "a", "close": "1"},
            {"timestamp": "2024-01-01T00:00:00.2", "source": "b", "close": "2"},
            {"timestamp": "2024-01-01T00:00:01", "source": "b", "close": "3"},
            {"symbol": "other"},
        ).drop("record_index"),
        CANDLE,
        "us",
    )
    found = as_set(charts.chart_series(rows), "symbol", "time", "close")
    assert found == {
        ("BTC/USDT", 1704067200, 2.0), ("BTC/USDT", 1704067201, 3.0), ("other", 1704067200, 11.0),
    }
    assert as_set(charts.largest_dataset(rows), "symbol") == {("BTC/USDT",)}


def test_plain_trees_can_be_read_and_taken_over(spark, root, tmp_path):
    typed = typed_cast(candles(spark, at(1), at(2)).drop("record_index"), CANDLE)
    rates_typed = typed_cast(rates(spark, at(1)).drop("record_index"), FUNDING)
    for rows, place in (
        (typed.where("day(timestamp) = 1"), "x/BTC/USDT/1h/2024-01-01.parquet"),
        (typed.where("day(timestamp) = 2"), "x/BTC/USDT/1h/2024-01-02.parquet"),
        (rates_typed, "x/BTC/funding_rate/2024-01-01.parquet"),
    ):
        path = tmp_path / "plain" / place
        path.parent.mkdir(parents=True, exist_ok=True)
        pq.write_table(rows.toArrow(), path)
    plain = str(tmp_path / "plain")
    assert store.scan_plain(spark, plain, CANDLE).count() == 2
    assert store.scan_plain(spark, plain, FUNDING).count() == 1
    sinks.write_candles(store.scan_plain(spark, plain, CANDLE), root)
    moved = result_strings(store.scan_candles(spark, root).drop("date"))
    assert moved.exceptAll(result_strings(typed)).count() == 0 and moved.count() == 2


def test_a_hot_partition_is_written_by_several_tasks(spark, root):
    """All rows are of one day; the partition is split instead of one huge file."""
    rows = spark.range(60_000).select(
        F.lit("x").alias("exchange"),
        F.concat(F.lit("S"), F.col("id")).alias("symbol"),
        F.lit("1h").alias("timeframe"),
        F.lit("2024-01-01T00:00:00").alias("timestamp"),
        *[F.lit("1").alias(f) for f in CANDLE.decimals],
        F.lit("x").alias("source"),
    )
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "256KB")
    try:
        sinks.write_candles(rows.repartition(8), root)
    finally:
        spark.conf.set(setting, before)
    assert store.list_files(spark, root).count() > 1
    assert store.scan_candles(spark, root).count() == 60_000
    sinks.write_candles(rows.limit(10).withColumn("close", F.lit("0.5")), root)
    assert store.scan_candles(spark, root).count() == 60_000
    assert store.scan_candles(spark, root).where("close = 0.5").count() == 10


def test_the_source_is_read_once(spark, tmp_path, monkeypatch):
    """Between verdict and write the source is gone; what was judged is what is stored."""
    import shutil

    from tickloom.plans import ingest

    source, root, side = (str(tmp_path / n) for n in ("source", "store", "side"))
    good = [{"timestamp": f"2024-01-0{d}T0{h}:00:00"} for d in (1, 2) for h in range(3)]
    candles(spark, *good, {"symbol": "BAD", "open": "x"}).repartition(3).write.parquet(source)
    publish = ingest.upsert

    def after_the_source_is_gone(*args, **options):
        shutil.rmtree(source)
        return publish(*args, **options)

    monkeypatch.setattr(ingest, "upsert", after_the_source_is_gone)
    batch = spark.read.parquet(source)
    result = validated_ingest(batch, root, CANDLE, scope=["symbol"], quarantine=side, mark=True)
    assert (result.written, result.held_back, result.issues) == (6, 1, 1)
    assert store.scan_candles(spark, root).count() == 6
    assert markers.ingest_log(spark, root).first()["records"] == 6


def test_a_set_without_a_name_is_held_back(spark, tmp_path):
    root, side = str(tmp_path / "store"), str(tmp_path / "side")
    batch = candles(spark, {}, {"symbol": "", "timestamp": "2024-01-01T01:00:00"})
    batch = batch.withColumn("symbol", F.expr("nullif(symbol, '')"))
    result = validated_ingest(batch, root, CANDLE, scope=["symbol"], quarantine=side)
    assert (result.written, result.held_back) == (1, 1)
    assert store.scan_candles(spark, root).where("symbol IS NULL").count() == 0


def test_written_tables_are_removed(spark, tmp_path):
    import os

    from tickloom.session import shared_dir

    folder_of = os.path.dirname(shared_dir(spark, "x"))
    before = set(os.listdir(folder_of))
    validated_ingest(candles(spark, {}), str(tmp_path / "store"), CANDLE)
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder_of)) - before}
    assert left <= {"touched"}


@pytest.mark.parametrize("order", ["ASC", "DESC"])
def test_deep_pages(spark, monkeypatch, order):
    monkeypatch.setattr(select, "TOP_ROWS", 40)
    monkeypatch.setattr(select, "RANGES", 8)
    # A third of the rows have one time, and times are uneven.
    hour = F.when(F.col("id") % 3 == 0, 5_000).otherwise(F.col("id") * F.col("id") % 7_919)
    rows = spark.range(700).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + hour * 60).cast("timestamp_ntz").alias("timestamp"),
        F.format_string("S%03d", F.col("id")).alias("symbol"),
    )
    rows = rows.withColumn("date", F.date_format("timestamp", "yyyy-MM-dd"))
    whole = rows.orderBy(*select.time_order(rows, order)).collect()
    for number, size in ((1, 20), (3, 20), (7, 50), (14, 50), (15, 50), (70, 10), (71, 10), (2, 350)):
        got = select.page(rows, number, size, order).collect()
        assert got == whole[(number - 1) * size : number * size], (number, size)
    assert select.page(rows.limit(0), 9, 10, order).count() == 0


@pytest.mark.parametrize("layout", [MARKET_DAY, SYMBOL_DAY])
def test_a_read_lists_what_is_asked(spark, tmp_path, layout):
    root = str(tmp_path)
    rows = [
        {"exchange": e, "symbol": s, "timestamp": f"2024-01-{d:02d}T0{h}:00:00"}
        for e in ("x", "y") for s in ("BTC/USDT", "ETH") for d in range(1, 13) for h in (1, 2)
    ]
    sinks.write_candles(candles(spark, *rows), root, layout=layout)
    everything = store.scan_candles(spark, root)
    base = folder(root, CANDLE)
    for asked in (
        {"exchange": "x", "symbol": "BTC/USDT", "timeframe": "1h", "start": "2024-01-05", "end": "2024-01-05T02:00:00"},
        {"exchange": "y", "start": "2024-01-11"},
        {"symbol": "ETH", "end": "2024-01-02T01:30:00"},
        {"exchange": "none"}, {"timeframe": "4h"}, {},
    ):
        wanted = store.Asked.of(**asked)
        read = store.scan(spark, root, CANDLE, wanted)
        got = select.get_candles(read, **asked, limit=1000).collect()
        assert got == select.get_candles(everything, **asked, limit=1000).collect(), asked
        folders = store.asked_folders(spark, base, wanted)
        if "exchange" in asked and asked["exchange"] == "x":
            assert len(folders) == 1 and "date=2024-01-05" in folders[0]
            assert len(read.inputFiles()) == 1
        if asked.get("exchange") == "none":
            assert folders == []


def test_wide_levels_are_left_to_spark(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_FOLDERS", 3)
    root = str(tmp_path)
    rows = [{"timestamp": f"2024-01-{d:02d}T01:00:00"} for d in range(1, 9)]
    sinks.write_candles(candles(spark, *rows), root)
    asked = store.Asked.of(exchange="x", start="2024-01-02")
    assert len(store.asked_folders(spark, folder(root, CANDLE), asked)) == 1
    read = store.scan(spark, root, CANDLE, asked)
    assert select.filter_time_range(read, "2024-01-02").count() == 7


def test_counts_from_footers(spark, tmp_path):
    root = str(tmp_path)
    rows = candles(spark, {"symbol": "B"}, {"symbol": "C"}, {"timestamp": "2024-02-01T00:00:00"})
    typed = typed_cast(rows.drop("record_index"), CANDLE)
    assert summary.footer_counts(spark, root, CANDLE).where("rows > 0").count() == 0
    sinks.write_candles(typed.withColumn("close", F.expr("CASE WHEN symbol <> 'C' THEN close END")), root)
    found = summary.footer_counts(spark, root, CANDLE)
    got = {r["name"]: (r["nulls"], r["rows"]) for r in found.collect()}
    assert got["close"] == (1, 3) and got["open"] == (0, 3) and "exchange" not in got
    plan = found._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*)" in plan
