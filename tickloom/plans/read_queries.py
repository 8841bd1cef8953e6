"""Queries that read the store: scans, filters, listings, charts and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import charts, coverage, merge, select, summary
from tickloom.operators.cast import display_strings, result_strings, schema_align, typed_cast
from tickloom.plans import views
from tickloom.plans.catalog import (
    CANDLE_TEXT,
    FUNDING_TEXT,
    STORED_TEXT,
    query,
    store,
)
from tickloom.plans.sql import raw_sql
from tickloom.schemas import CANDLE, CANDLE_FIELDS, FUNDING, FUNDING_FIELDS
from tickloom.session import shared_dir
from tickloom.sources import catalogue, sinks
from tickloom.sources import store as files
from tickloom.sources.layout import SYMBOL_DAY, folder
from tickloom.sources.sinks import upsert


def _candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scan_candles(spark, store(spark, sf_dir))


def _funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scan_funding(spark, store(spark, sf_dir))


def _text(rows: DataFrame) -> DataFrame:
    return result_strings(rows.drop("date"))


# --- scans and files -------------------------------------------------------------


@query("scan_candles", f"SELECT {CANDLE_TEXT} FROM candles", ("candles",))
def scan_candles(spark, sf_dir):
    return _text(_candles(spark, sf_dir))


@query("scan_funding", f"SELECT {FUNDING_TEXT} FROM funding", ("funding",))
def scan_funding(spark, sf_dir):
    return _text(_funding(spark, sf_dir))


_DATASET_FILES = """
SELECT 'candle' AS type, exchange, symbol, timeframe,
  COUNT(DISTINCT substr(timestamp, 1, 10)) AS files, COUNT(*) AS rows
FROM candles_raw GROUP BY exchange, symbol, timeframe
UNION ALL
SELECT 'funding_rate', exchange, symbol, NULL,
  COUNT(DISTINCT substr(timestamp, 1, 10)), COUNT(*)
FROM funding_raw GROUP BY exchange, symbol"""


@query(
    "discover_datasets",
    f"SELECT type, exchange, symbol, timeframe, files FROM ({_DATASET_FILES}) d",
    ("candles_raw", "funding_raw"),
)
def discover_datasets(spark, sf_dir):
    found = files.discover_datasets(spark, store(spark, sf_dir))
    return found.groupBy(*summary.DATASET).agg(F.count(F.lit(1)).alias("files"))


@query(
    "discover_plain_paths",
    """
SELECT 'candle' AS type, exchange, symbol, timeframe, COUNT(*) AS files FROM (
  SELECT DISTINCT exchange, symbol, timeframe, substr(timestamp, 1, 10) AS day FROM candles_raw
) a GROUP BY exchange, symbol, timeframe
UNION ALL
SELECT 'funding_rate', exchange, symbol, NULL, COUNT(*) FROM (
  SELECT DISTINCT exchange, symbol, substr(timestamp, 1, 10) AS day FROM funding_raw
) b GROUP BY exchange, symbol""",
    ("candles_raw", "funding_raw"),
)
def discover_plain_paths(spark, sf_dir):
    def paths(rows: DataFrame, anchor) -> DataFrame:
        day = F.concat(F.substring("timestamp", 1, 10), F.lit(".parquet"))
        path = F.concat_ws("/", F.lit("s3a://lake/root"), "exchange", "symbol", anchor, day)
        stray = F.concat_ws("/", F.lit("s3a://lake/root"), "exchange", F.lit("x.parquet"))
        return rows.select(F.explode(F.array(path, stray)).alias("path")).distinct()

    listing = paths(views.candles_raw(spark, sf_dir), F.col("timeframe")).unionByName(
        paths(views.funding_raw(spark, sf_dir), F.lit("funding_rate"))
    )
    found = files.discover_plain(listing, "s3a://lake/root")
    return found.groupBy(*summary.DATASET).agg(F.count(F.lit(1)).alias("files"))


@query(
    "inspect_scan",
    f"SELECT {CANDLE_TEXT} FROM candles WHERE timestamp >= TIMESTAMP '2024-01-05 00:00:00' "
    "AND timestamp < TIMESTAMP '2024-01-20 12:00:00'",
    ("candles",),
)
def inspect_scan(spark, sf_dir):
    root = folder(store(spark, sf_dir), CANDLE)
    rows = files.inspect_scan(spark, root, "2024-01-05", "2024-01-20T12:00:00")
    return _text(rows).select(*CANDLE_FIELDS)


@query(
    "file_footers",
    """
SELECT exchange, timeframe, substr(timestamp, 1, 10) AS date, COUNT(*) AS rows,
  'SNAPPY' AS compression
FROM candles_raw GROUP BY ALL""",
    ("candles_raw",),
)
def file_footers(spark, sf_dir):
    root = folder(store(spark, sf_dir), CANDLE)

    def part(name: str):
        return F.regexp_extract("path", f"/{name}=([^/]+)/", 1).alias(name)

    footers = files.file_footers(spark, root).select(
        part("exchange"), part("timeframe"), part("date"), "rows", "compression"
    )
    return footers.groupBy("exchange", "timeframe", "date", "compression").agg(
        F.sum("rows").alias("rows")
    )


# --- filters ---------------------------------------------------------------------


@query(
    "filter_exchange", f"SELECT {CANDLE_TEXT} FROM candles WHERE exchange = 'click'", ("candles",)
)
def filter_exchange(spark, sf_dir):
    return _text(select.filter_exchange(_candles(spark, sf_dir), "click"))


@query(
    "filter_symbol", f"SELECT {CANDLE_TEXT} FROM candles WHERE symbol = 'S3/USDT'", ("candles",)
)
def filter_symbol(spark, sf_dir):
    return _text(select.filter_symbol(_candles(spark, sf_dir), "S3/USDT"))


@query(
    "filter_timeframe", f"SELECT {CANDLE_TEXT} FROM candles WHERE timeframe = '1h'", ("candles",)
)
def filter_timeframe(spark, sf_dir):
    return _text(select.filter_timeframe(_candles(spark, sf_dir), "1h"))


@query(
    "filter_time_range",
    f"SELECT {CANDLE_TEXT} FROM candles WHERE timestamp >= TIMESTAMP '2024-01-05 00:00:00' "
    "AND timestamp < TIMESTAMP '2024-01-20 12:00:00'",
    ("candles",),
)
def filter_time_range(spark, sf_dir):
    rows = _candles(spark, sf_dir)
    return _text(select.filter_time_range(rows, "2024-01-05", "2024-01-20T12:00"))


@query(
    "get_candles",
    f"""
SELECT {CANDLE_TEXT} FROM (
  SELECT * FROM candles WHERE exchange = 'purchase' AND timeframe = '1h'
    AND timestamp >= TIMESTAMP '2024-01-03 00:00:00' AND timestamp < TIMESTAMP '2024-01-25 00:00:00'
  ORDER BY timestamp DESC, exchange, symbol, timeframe, source LIMIT 100) t""",
    ("candles",),
)
def get_candles(spark, sf_dir):
    rows = select.get_candles(
        _candles(spark, sf_dir),
        exchange="purchase",
        timeframe="1h",
        start="2024-01-03",
        end="2024-01-25T00:00:00",
    )
    return _text(rows)


@query(
    "get_funding_rates",
    f"""
SELECT {FUNDING_TEXT} FROM (
  SELECT * FROM funding WHERE symbol = 'S4/USDT' AND timestamp >= TIMESTAMP '2024-01-03 00:00:00'
  ORDER BY timestamp ASC, exchange, symbol, source LIMIT 50) t""",
    ("funding",),
)
def get_funding_rates(spark, sf_dir):
    rows = select.get_funding_rates(
        _funding(spark, sf_dir), symbol="S4/USDT", start="2024-01-03", limit=50, order="ASC"
    )
    return _text(rows)


@query(
    "hide_fake",
    """
SELECT exchange, symbol, COUNT(*) AS rows FROM candles_raw GROUP BY exchange, symbol""",
    ("candles_raw",),
)
def hide_fake(spark, sf_dir):
    rows = _candles(spark, sf_dir).drop("date")
    with_fake = rows.unionByName(rows.withColumn("exchange", F.lit("fake")))
    kept = select.hide_fake(with_fake)
    return kept.groupBy("exchange", "symbol").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "project_columns",
    "SELECT CAST(open AS VARCHAR) AS open, CAST(close AS VARCHAR) AS close FROM candles "
    "WHERE open = CAST('12.34' AS DECIMAL(38,10)) OR open < 10",
    ("candles",),
)
def project_columns(spark, sf_dir):
    rows = _candles(spark, sf_dir)
    wanted = (F.col("open") == F.lit("12.34").cast("decimal(38,10)")) | (F.col("open") < 10)
    return result_strings(rows.where(wanted).select("open", "close"))


@query(
    "typed_cast",
    """
SELECT exchange, symbol, timestamp, source,
  regexp_replace(concat(close, '99999999999'), '(\\.[0-9]{10})[0-9]+$', '\\1') AS close,
  CAST(CAST(open AS DECIMAL(38,10)) AS VARCHAR) AS open
FROM candles_raw""",
    ("candles_raw",),
)
def typed(spark, sf_dir):
    raw = views.candles_raw(spark, sf_dir)
    longer = raw.withColumn("close", F.concat("close", F.lit("99999999999")))
    return result_strings(typed_cast(longer, CANDLE)).select(
        "exchange", "symbol", "timestamp", "source", "close", "open"
    )


@query("schema_align", f"SELECT {CANDLE_TEXT} FROM candles", ("candles",))
def aligned(spark, sf_dir):
    rows = views.candles(spark, sf_dir)
    older = rows.select(
        "source",
        F.col("timestamp").cast("string").alias("timestamp"),
        *[F.col(f).cast("decimal(20,4)").alias(f) for f in CANDLE.decimals],
        "timeframe",
        "symbol",
        "exchange",
    )
    return result_strings(schema_align(older, rows.schema))


@query("result_strings", f"SELECT {CANDLE_TEXT} FROM candles", ("candles",))
def strings(spark, sf_dir):
    return result_strings(views.candles(spark, sf_dir))


# --- charts ----------------------------------------------------------------------

_DOUBLES = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in CANDLE.decimals)
_EPOCH = "CAST(epoch(CAST(timestamp AS TIMESTAMP)) AS BIGINT) AS time"


@query(
    "chart_series",
    f"SELECT exchange, symbol, timeframe, {_EPOCH}, {_DOUBLES} FROM candles_raw",
    ("candles_raw",),
)
def chart_series(spark, sf_dir):
    return charts.chart_series(_candles(spark, sf_dir).drop("date"))


@query(
    "funding_series",
    f"""
SELECT exchange, symbol, {_EPOCH}, 'rate' AS series, CAST(rate AS DOUBLE) AS value
FROM funding_raw
UNION ALL
SELECT exchange, symbol, {_EPOCH}, 'predicted_rate', CAST(predicted_rate AS DOUBLE)
FROM funding_raw""",
    ("funding_raw",),
)
def funding_series(spark, sf_dir):
    return charts.funding_series(_funding(spark, sf_dir))


@query(
    "first_per_second",
    f"""
SELECT exchange, symbol, timeframe, {_EPOCH}, {STORED_TEXT.split("timeframe, ", 1)[1]} FROM (
  SELECT *, row_number() OVER (PARTITION BY exchange, symbol, timeframe, timestamp
    ORDER BY source) AS rn
  FROM (SELECT * FROM candles_raw UNION ALL SELECT * FROM incoming WHERE source = 'replay') u) r
WHERE rn = 1""",
    ("candles_raw", "incoming"),
)
def first_per_second(spark, sf_dir):
    later = views.candles_incoming(spark, sf_dir).where(F.col("source") == "replay")
    rows = views.candles_raw(spark, sf_dir).unionByName(later)
    return _text(charts.first_per_second(typed_cast(rows, CANDLE)))


@query(
    "largest_dataset",
    f"""
SELECT {CANDLE_TEXT} FROM candles WHERE (exchange, symbol, timeframe) IN (
  SELECT (exchange, symbol, timeframe) FROM candles GROUP BY exchange, symbol, timeframe
  ORDER BY COUNT(*) DESC, exchange, symbol, timeframe LIMIT 1)""",
    ("candles",),
)
def largest_dataset(spark, sf_dir):
    return _text(charts.largest_dataset(_candles(spark, sf_dir)))


@query(
    "read_asked_days",
    f"""
SELECT {CANDLE_TEXT} FROM candles WHERE exchange = 'view' AND timeframe = '1h'
  AND timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp < TIMESTAMP '2024-01-08 12:00:00'""",
    ("candles",),
)
def read_asked_days(spark, sf_dir):
    """Some days of a market, from their folders alone."""
    bounds = {"start": "2024-01-05", "end": "2024-01-08T12:00:00"}
    asked = files.Asked.of(exchange="view", timeframe="1h", **bounds)
    rows = files.scan(spark, store(spark, sf_dir), CANDLE, asked)
    rows = select.filter_timeframe(select.filter_exchange(rows, "view"), "1h")
    return _text(select.filter_time_range(rows, **bounds))


# --- ordering and paging ---------------------------------------------------------


@query(
    "order_limit",
    f"""
SELECT {CANDLE_TEXT} FROM (
  SELECT * FROM candles ORDER BY timestamp ASC, exchange, symbol, timeframe, source LIMIT 250) t""",
    ("candles",),
)
def order_limit(spark, sf_dir):
    return _text(select.order_limit(_candles(spark, sf_dir), "ASC", 250))


def _edge(agg: str) -> str:
    return f"""
SELECT {CANDLE_TEXT} FROM candles WHERE (exchange, symbol, timeframe, timestamp) IN (
  SELECT (exchange, symbol, timeframe, {agg}(timestamp)) FROM candles
  GROUP BY exchange, symbol, timeframe)"""


@query("latest_candle", _edge("MAX"), ("candles",))
def latest_candle(spark, sf_dir):
    rows = _candles(spark, sf_dir).drop("date")
    return _text(select.newest_per(rows, ["exchange", "symbol", "timeframe"]))


@query("earliest_candle", _edge("MIN"), ("candles",))
def earliest_candle(spark, sf_dir):
    rows = _candles(spark, sf_dir).drop("date")
    return _text(select.newest_per(rows, ["exchange", "symbol", "timeframe"], oldest=True))


@query(
    "sample_rows",
    """
SELECT exchange, symbol, timeframe, timestamp,
  rtrim(rtrim(open, '0'), '.') AS open, rtrim(rtrim(close, '0'), '.') AS close
FROM (SELECT * FROM candles_raw ORDER BY exchange, symbol, timestamp LIMIT 10) t""",
    ("candles_raw",),
)
def sample_rows(spark, sf_dir):
    rows = select.sample_rows(_candles(spark, sf_dir), ["exchange", "symbol", "timestamp"])
    return display_strings(
        rows.select("exchange", "symbol", "timeframe", "timestamp", "open", "close")
    )


@query(
    "page",
    f"""
SELECT {CANDLE_TEXT} FROM (
  SELECT * FROM candles ORDER BY timestamp DESC, exchange, symbol, timeframe, source
  LIMIT 50 OFFSET 100) t""",
    ("candles",),
)
def page(spark, sf_dir):
    return _text(select.page(_candles(spark, sf_dir), 3, 50))


@query(
    "deep_page",
    f"""
SELECT {CANDLE_TEXT} FROM (
  SELECT *, row_number() OVER (ORDER BY timestamp DESC, exchange, symbol, timeframe, source) AS pos,
    count(*) OVER () AS n FROM candles) t
WHERE (pos - 1) // greatest(1, n // 7) = 4""",
    ("candles",),
)
def deep_page(spark, sf_dir):
    """The fifth of pages that hold a seventh of all rows, found by counting ranges of time."""
    rows = _candles(spark, sf_dir)
    size = max(1, rows.count() // 7)
    around, skipped = select.around_page(rows, 4 * size, size, descending=True)
    return _text(around.orderBy(*select.time_order(around)).offset(skipped).limit(size))


@query(
    "page_after",
    f"""
SELECT {CANDLE_TEXT} FROM (
  SELECT * FROM candles
  WHERE timestamp > TIMESTAMP '2024-01-10 05:00:00'
    OR (timestamp = TIMESTAMP '2024-01-10 05:00:00' AND exchange > 'error')
    OR (timestamp = TIMESTAMP '2024-01-10 05:00:00' AND exchange = 'error' AND symbol > 'S5/USDT')
  ORDER BY timestamp, exchange, symbol LIMIT 100) t""",
    ("candles",),
)
def page_after(spark, sf_dir):
    last = [F.lit("2024-01-10 05:00:00").cast("timestamp_ntz"), "error", "S5/USDT"]
    keys = ["timestamp", "exchange", "symbol"]
    return _text(select.page_after(_candles(spark, sf_dir), keys, last, 100))


@query(
    "page_count",
    "SELECT COUNT(*) AS rows, CAST(GREATEST(CEIL(COUNT(*) / 50.0), 1) AS BIGINT) AS pages "
    "FROM candles_raw",
    ("candles_raw",),
)
def page_count(spark, sf_dir):
    return select.page_count(_candles(spark, sf_dir), 50)


@query(
    "sql_row_cap",
    f"SELECT {CANDLE_TEXT} FROM (SELECT * FROM candles ORDER BY volume DESC, exchange, symbol, "
    "timestamp LIMIT 40) t",
    ("candles",),
)
def sql_row_cap(spark, sf_dir):
    text = (
        "SELECT " + ", ".join(CANDLE_FIELDS) + " FROM candles "
        "ORDER BY volume DESC, exchange, symbol, timestamp"
    )
    return raw_sql(spark, text, store(spark, sf_dir), limit=40)


# --- aggregates ------------------------------------------------------------------


@query("dataset_summary", _DATASET_FILES, ("candles_raw", "funding_raw"))
def dataset_summary(spark, sf_dir):
    return summary.dataset_summary(spark, store(spark, sf_dir))


@query(
    "catalogue_after_writes",
    f"{_DATASET_FILES.replace('candles_raw', 'merged')}",
    ("candles_raw", "funding_raw", "merged"),
)
def catalogue_after_writes(spark, sf_dir):
    """Datasets as the catalogue knows them after a merge of both strategies."""
    root = shared_dir(spark, "catalogued")
    sinks.write_candles(views.candles_raw(spark, sf_dir), root)
    incoming = views.candles_incoming(spark, sf_dir)
    even = F.substring("timestamp", 9, 2).cast("int") % 2 == 0
    sinks.write_candles(incoming.where(even), root)
    sinks.write_candles(incoming.where(~even), root, strategy=merge.CHANGES)
    sinks.write_funding(views.funding_raw(spark, sf_dir), root)
    parts = [
        catalogue.known_datasets(spark, root, kind).withColumn("type", F.lit(kind.name))
        for kind in (CANDLE, FUNDING)
    ]
    return parts[0].unionByName(parts[1])


@query(
    "list_datasets",
    """
SELECT DISTINCT 'candle' AS type, concat(exchange, '/', symbol, '/', timeframe) AS dataset
FROM candles_raw
UNION ALL
SELECT DISTINCT 'funding_rate', concat(exchange, '/', symbol, '/funding_rate') FROM funding_raw""",
    ("candles_raw", "funding_raw"),
)
def list_datasets(spark, sf_dir):
    return summary.list_datasets(summary.dataset_summary(spark, store(spark, sf_dir)))


def _stat(name: str, decimal: bool) -> str:
    low, high = (
        (f"CAST(MIN({name}) AS VARCHAR)", f"CAST(MAX({name}) AS VARCHAR)")
        if decimal
        else ("CAST(NULL AS VARCHAR)", "CAST(NULL AS VARCHAR)")
    )
    nulls = f"COUNT(*) FILTER (WHERE {name} IS NULL)"
    return f"SELECT '{name}' AS name, {nulls} AS nulls, {low} AS min, {high} AS max FROM candles"


@query(
    "column_stats",
    " UNION ALL ".join(_stat(f, f in CANDLE.decimals) for f in CANDLE_FIELDS),
    ("candles",),
)
def column_stats(spark, sf_dir):
    return summary.column_stats(_candles(spark, sf_dir).drop("date"))


@query(
    "footer_counts",
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, COUNT(*) FILTER (WHERE {name} IS NULL) AS nulls, COUNT(*) AS rows "
        "FROM candles"
        for name in CANDLE_FIELDS
        if name not in ("exchange", "timeframe")
    ),
    ("candles",),
)
def footer_counts(spark, sf_dir):
    return summary.footer_counts(spark, store(spark, sf_dir), CANDLE)


@query("row_count", "SELECT COUNT(*) AS rows FROM candles_raw", ("candles_raw",))
def row_count(spark, sf_dir):
    return summary.row_count(_candles(spark, sf_dir))


@query(
    "count_by_symbol",
    "SELECT symbol, COUNT(*) AS rows FROM candles_raw GROUP BY symbol",
    ("candles_raw",),
)
def count_by_symbol(spark, sf_dir):
    return summary.count_by_symbol(_candles(spark, sf_dir))


@query(
    "facet_values",
    """
SELECT DISTINCT 'exchange' AS facet, exchange AS value FROM candles_raw
UNION ALL SELECT DISTINCT 'symbol', symbol FROM candles_raw WHERE exchange = 'view'
UNION ALL SELECT DISTINCT 'timeframe', timeframe FROM candles_raw
  WHERE exchange = 'view' AND symbol = 'S1/USDT'""",
    ("candles_raw",),
)
def facet_values(spark, sf_dir):
    found = summary.dataset_summary(spark, store(spark, sf_dir))
    datasets = found.where(F.col("type") == "candle")
    return select.facet_values(datasets, "view", "S1/USDT")


@query(
    "ingest_counts",
    """
SELECT 'candle' AS data_type, exchange AS provider, symbol, timeframe, COUNT(*) AS records
FROM incoming GROUP BY exchange, symbol, timeframe""",
    ("incoming",),
)
def ingest_counts(spark, sf_dir):
    return summary.ingest_counts(views.candles_incoming(spark, sf_dir), CANDLE)


# --- resume and coverage ---------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested sets from events; those of other timeframes have no stored rows."""
    user = F.col("user_id")
    timeframe = F.when(user % 4 == 1, "4h").when(user % 4 == 2, "2y").otherwise("1h")
    return (
        views.table(spark, sf_dir, "events")
        .select(
            F.col("event_type").alias("exchange"),
            F.concat(F.lit("S"), (user % 10).cast("string"), F.lit("/USDT")).alias("symbol"),
            timeframe.alias("timeframe"),
        )
        .distinct()
    )


_REQUESTS_SQL = """
requests AS (SELECT DISTINCT event_type AS exchange,
  concat('S', CAST(user_id % 10 AS STRING), '/USDT') AS symbol,
  CASE WHEN user_id % 4 = 1 THEN '4h' WHEN user_id % 4 = 2 THEN '2y' ELSE '1h' END AS timeframe
  FROM events)"""


@query(
    "resume_points",
    f"""
WITH {_REQUESTS_SQL},
last AS (SELECT exchange, symbol, timeframe, MAX(timestamp) AS t FROM candles
  GROUP BY exchange, symbol, timeframe)
SELECT r.exchange, r.symbol, r.timeframe,
  strftime(t, '%Y-%m-%dT%H:%M:%S') AS last_timestamp,
  strftime(t + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') AS start,
  CASE WHEN r.timeframe = '2y' THEN 'unknown timeframe'
    WHEN t IS NULL THEN 'no stored data' END AS problem
FROM requests r LEFT JOIN last l
  ON r.exchange = l.exchange AND r.symbol = l.symbol AND r.timeframe = l.timeframe""",
    ("candles",),
)
def resume_points(spark, sf_dir):
    points = coverage.resume_points(_requests(spark, sf_dir), _candles(spark, sf_dir))
    return result_strings(points)


@query(
    "coverage_check",
    f"""
WITH {_REQUESTS_SQL},
first AS (SELECT exchange, symbol, timeframe, MIN(timestamp) AS t FROM candles
  GROUP BY exchange, symbol, timeframe),
asked AS (SELECT *, CASE WHEN symbol < 'S5' THEN '2023-12-31' ELSE '2024-01-01T06:00:00' END AS start
  FROM requests)
SELECT r.exchange, r.symbol, r.timeframe, substr(start, 1, 10) AS start_date,
  strftime(t, '%Y-%m-%dT%H:%M:%S') AS first_timestamp,
  COALESCE(strftime(t, '%Y-%m-%d') > substr(start, 1, 10), FALSE) AS refused
FROM asked r LEFT JOIN first l
  ON r.exchange = l.exchange AND r.symbol = l.symbol AND r.timeframe = l.timeframe""",
    ("candles",),
)
def coverage_check(spark, sf_dir):
    start = F.when(F.col("symbol") < "S5", "2023-12-31").otherwise("2024-01-01T06:00:00")
    asked = _requests(spark, sf_dir).withColumn("start", start)
    return result_strings(coverage.coverage_check(asked, _candles(spark, sf_dir)))


# --- set operations and SQL ------------------------------------------------------


@query(
    "union_all",
    "SELECT * FROM candles_raw UNION ALL SELECT * FROM incoming",
    ("candles_raw", "incoming"),
)
def union_all(spark, sf_dir):
    return views.candles_raw(spark, sf_dir).unionByName(views.candles_incoming(spark, sf_dir))


@query(
    "union_datasets",
    f"SELECT {CANDLE_TEXT} FROM candles WHERE (exchange = 'click' AND symbol = 'S1/USDT') "
    "OR (exchange = 'error' AND symbol = 'S2/USDT')",
    ("candles",),
)
def union_datasets(spark, sf_dir):
    rows = _candles(spark, sf_dir)
    one = (F.col("exchange") == "click") & (F.col("symbol") == "S1/USDT")
    other = (F.col("exchange") == "error") & (F.col("symbol") == "S2/USDT")
    return _text(rows.where(one | other))


@query(
    "raw_sql",
    """
SELECT c.exchange, c.symbol, COUNT(*) AS n, CAST(MAX(c.high) AS VARCHAR) AS top,
  CAST(MIN(f.rate) AS VARCHAR) AS low_rate
FROM candles c JOIN funding f ON c.exchange = f.exchange AND c.symbol = f.symbol
  AND CAST(c.timestamp AS DATE) = CAST(f.timestamp AS DATE)
GROUP BY c.exchange, c.symbol""",
    ("candles", "funding"),
)
def sql_join(spark, sf_dir):
    text = """
SELECT c.exchange, c.symbol, COUNT(*) AS n, MAX(c.high) AS top, MIN(f.rate) AS low_rate
FROM candles c JOIN funding_rates f
  ON c.exchange = f.exchange AND c.symbol = f.symbol AND c.date = f.date
GROUP BY c.exchange, c.symbol"""
    return raw_sql(spark, text, store(spark, sf_dir), limit=0)


@query(
    "sql_cte",
    """
WITH q AS (SELECT symbol, COUNT(*) AS n FROM candles WHERE close > open GROUP BY symbol)
SELECT symbol, n FROM q WHERE n > 1""",
    ("candles",),
)
def sql_cte(spark, sf_dir):
    text = """
WITH q AS (SELECT symbol, COUNT(*) AS n FROM candles WHERE close > open GROUP BY symbol)
SELECT symbol, n FROM q WHERE n > 1"""
    return raw_sql(spark, text, store(spark, sf_dir), limit=0)


@query(
    "symbol_folders",
    f"SELECT {FUNDING_TEXT} FROM funding WHERE symbol = 'S3/USDT'",
    ("funding",),
)
def symbol_folders(spark, sf_dir):
    """The layout with one folder per symbol; the symbol filter prunes folders."""
    root = shared_dir(spark, "symbols")
    rates = views.funding(spark, sf_dir)
    upsert(rates, root, FUNDING, layout=SYMBOL_DAY, incoming_unique=True)
    rows = select.filter_symbol(files.scan_funding(spark, root), "S3/USDT")
    return _text(rows).select(*FUNDING_FIELDS)
