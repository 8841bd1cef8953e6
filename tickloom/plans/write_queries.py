"""Queries that validate, merge, normalise and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import text, times
from tickloom.functions.native import TIMEFRAME_CODES, native_symbol, timeframe_pairs
from tickloom.operators import merge, normalise, validate
from tickloom.operators.cast import result_strings
from tickloom.plans import views
from tickloom.plans.catalog import (
    STORED_FUNDING_TEXT,
    STORED_TEXT,
    query,
)
from tickloom.plans.ingest import SET, incremental_backfill, validated_ingest
from tickloom.plans.rendering import BARE_NUMBERS, render
from tickloom.plans.views import table
from tickloom.schemas import CANDLE, CANDLE_FIELDS, FUNDING, FUNDING_FIELDS
from tickloom.session import shared_dir
from tickloom.sources import markers, payloads, sinks, synthetic
from tickloom.sources.store import scan, scan_candles, scan_funding
from tickloom.streaming.follow import follow, follow_since_last
from tickloom.streaming.retries import open_failures, solved_failures

# --- validation ------------------------------------------------------------------

_DECIMAL = "^-?[0-9]+(\\.[0-9]+)?$"
_UNSIGNED = "^[0-9]+(\\.[0-9]+)?$"
_TIME = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?$"
_ISSUE = "record_index, severity, code, field, message"


def _issue(source: str, severity: str, code: str, field: str, where: str, message: str) -> str:
    return (
        f"SELECT record_index, '{severity}' AS severity, '{code}' AS code, '{field}' AS field, "
        f"{message} AS message FROM {source} WHERE {where}"
    )


def _quoted(before: str, value: str, after: str) -> str:
    before, after = before.replace("'", "''"), after.replace("'", "''")
    return f"concat('{before}', {value}, '{after}')"


def _sql_empty(source: str, fields) -> list[str]:
    return [
        _issue(source, "error", "EMPTY_FIELD", f, f"trim({f}) = ''", f"'Field ''{f}'' is empty.'")
        for f in fields
    ]


def _sql_decimal(source: str, fields) -> list[str]:
    return [
        _issue(
            source,
            "error",
            "INVALID_DECIMAL",
            f,
            f"NOT regexp_matches({f}, '{_DECIMAL}')",
            _quoted(f"Field '{f}' is not a valid decimal string: '", f, "'."),
        )
        for f in fields
    ]


def _sql_precision(source: str, fields) -> list[str]:
    return [
        _issue(
            source,
            "warning",
            "PRECISION_OVERFLOW",
            f,
            f"regexp_matches({f}, '{_DECIMAL}') AND "
            f"length(replace(replace({f}, '-', ''), '.', '')) > 38",
            _quoted(f"Field '{f}' exceeds 38-digit precision: '", f, "'."),
        )
        for f in fields
    ]


def _sql_negative(source: str) -> list[str]:
    return [
        _issue(
            source,
            "error",
            "NEGATIVE_VALUE",
            f,
            f"{f} LIKE '-%'",
            _quoted(f"Field '{f}' is negative: '", f, "'."),
        )
        for f in CANDLE.decimals
    ]


def _sql_time(source: str, fields) -> list[str]:
    return [
        _issue(
            source,
            "error",
            "INVALID_TIMESTAMP",
            f,
            f"NOT regexp_matches({f}, '{_TIME}')",
            _quoted(
                "Timestamp is not a valid ISO-8601 string: '"
                if len(fields) == 1
                else f"Field '{f}' is not a valid ISO-8601 string: '",
                f,
                "'.",
            ),
        )
        for f in fields
    ]


def _sql_ohlc(source: str) -> list[str]:
    # Text of up to 41 digits is compared as (length, digits) of hundredths.
    valid = " AND ".join(
        f"regexp_matches({f}, '{_UNSIGNED}')" for f in ("open", "high", "low", "close")
    )

    def less(a: str, b: str) -> str:
        def digits(x: str) -> str:
            whole = f"ltrim(split_part({x}, '.', 1), '0')"
            return f"concat(lpad({whole}, 50, '0'), rpad(split_part({x}, '.', 2), 20, '0'))"

        return f"{digits(a)} < {digits(b)}"

    cases = [
        ("high", "high", "open", "is less than"),
        ("high", "high", "close", "is less than"),
        ("low", "open", "low", "exceeds"),
        ("low", "close", "low", "exceeds"),
    ]
    found = []
    for field, larger, smaller, verb in cases:
        other = smaller if field == larger else larger
        message = (
            f"concat('''{field}'' (', {field}, ') {verb} ''{other}'' (', {other}, ').')"
        )
        found.append(
            _issue(
                source,
                "error",
                "OHLC_INVARIANT",
                field,
                f"CASE WHEN {valid} THEN {less(larger, smaller)} ELSE FALSE END",
                message,
            )
        )
    return found


def _sql_rate(source: str) -> list[str]:
    return [
        _issue(
            source,
            "warning",
            "FUNDING_RATE_OUT_OF_RANGE",
            f,
            f"CASE WHEN regexp_matches({f}, '{_DECIMAL}') THEN abs(CAST({f} AS DOUBLE)) >= 0.005 "
            "ELSE FALSE END",
            f"concat('Field ''{f}'' (', {f}, ') exceeds typical ±0.5% range.')",
        )
        for f in FUNDING.decimals
    ]


def _sql_next(source: str) -> list[str]:
    return [
        _issue(
            source,
            "error",
            "FUTURE_BEFORE_CURRENT",
            "next_funding_time",
            f"regexp_matches(timestamp, '{_TIME}') AND regexp_matches(next_funding_time, '{_TIME}')"
            " AND timestamp >= next_funding_time",
            "concat('next_funding_time (', next_funding_time, ') is not after timestamp (', "
            "timestamp, ').')",
        )
    ]


def _sql_duplicate(source: str, key) -> list[str]:
    shown = ", '/', ".join(key[:-1])
    inner = (
        f"(SELECT *, row_number() OVER (PARTITION BY {', '.join(key)} ORDER BY record_index) AS rn "
        f"FROM {source}) d"
    )
    return [
        _issue(
            inner,
            "error",
            "DUPLICATE_TIMESTAMP",
            "timestamp",
            "rn > 1",
            f"concat('Duplicate timestamp ''', timestamp, ''' for ', {shown}, '.')",
        )
    ]


def _all(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


_CANDLE_RULES = _all(
    _sql_empty("candles_dirty", CANDLE_FIELDS)
    + _sql_decimal("candles_dirty", CANDLE.decimals)
    + _sql_precision("candles_dirty", CANDLE.decimals)
    + _sql_negative("candles_dirty")
    + _sql_time("candles_dirty", ("timestamp",))
    + _sql_ohlc("candles_dirty")
    + _sql_duplicate("candles_dirty", CANDLE.key)
)
_FUNDING_RULES = _all(
    _sql_empty("funding_dirty", FUNDING_FIELDS)
    + _sql_decimal("funding_dirty", FUNDING.decimals)
    + _sql_precision("funding_dirty", FUNDING.decimals)
    + _sql_rate("funding_dirty")
    + _sql_time("funding_dirty", ("timestamp", "next_funding_time"))
    + _sql_next("funding_dirty")
    + _sql_duplicate("funding_dirty", FUNDING.key)
)


def _only(checks, code: str):
    return [c for c in checks if c.code == code]


def _shown(issues: DataFrame) -> DataFrame:
    return issues.select(*_ISSUE.split(", "))


def _rule(name: str, code: str, sql: list[str], kind=CANDLE) -> None:
    source = "candles_dirty" if kind is CANDLE else "funding_dirty"

    @query(name, _all(sql), (source,))
    def run(spark, sf_dir):
        batch = getattr(views, source)(spark, sf_dir)
        return _shown(validate.row_issues(batch, kind, _only(validate.checks_for(kind), code)))


_rule("v_empty", validate.EMPTY_FIELD, _sql_empty("candles_dirty", CANDLE_FIELDS))
_rule("v_decimal", validate.INVALID_DECIMAL, _sql_decimal("candles_dirty", CANDLE.decimals))
_rule("v_precision", validate.PRECISION_OVERFLOW, _sql_precision("candles_dirty", CANDLE.decimals))
_rule("v_negative", validate.NEGATIVE_VALUE, _sql_negative("candles_dirty"))
_rule("v_timestamp", validate.INVALID_TIMESTAMP, _sql_time("candles_dirty", ("timestamp",)))
_rule("v_ohlc", validate.OHLC_INVARIANT, _sql_ohlc("candles_dirty"))
_rule("v_rate_range", validate.FUNDING_RATE_OUT_OF_RANGE, _sql_rate("funding_dirty"), FUNDING)
_rule("v_next_after", validate.FUTURE_BEFORE_CURRENT, _sql_next("funding_dirty"), FUNDING)


@query("v_duplicate", _all(_sql_duplicate("candles_dirty", CANDLE.key)), ("candles_dirty",))
def v_duplicate(spark, sf_dir):
    return _shown(validate.duplicate_issues(views.candles_dirty(spark, sf_dir), CANDLE))


@query(
    "decimal_gte",
    """
SELECT record_index, CAST(open AS DECIMAL(30,10)) >= CAST(close AS DECIMAL(30,10)) AS open_gte_close,
  CAST(volume AS DECIMAL(30,10)) >= CAST(high AS DECIMAL(30,10)) AS volume_gte_high
FROM candles_indexed""",
    ("candles_indexed",),
)
def decimal_gte(spark, sf_dir):
    rows = views.candles_indexed(spark, sf_dir)
    padded = F.concat(F.lit("000"), F.col("open"))
    longer = F.concat(F.col("volume"), F.lit("000"))
    return rows.select(
        validate.INDEX,
        text.decimal_gte(padded, F.col("close")).alias("open_gte_close"),
        text.decimal_gte(longer, F.col("high")).alias("volume_gte_high"),
    )


@query("validate_candles", _CANDLE_RULES, ("candles_dirty",))
def validate_candles(spark, sf_dir):
    return _shown(validate.validate_candles(views.candles_dirty(spark, sf_dir)))


@query("validate_funding", _FUNDING_RULES, ("funding_dirty",))
def validate_funding(spark, sf_dir):
    return _shown(validate.validate_funding(views.funding_dirty(spark, sf_dir)))


_VERDICT = """
SELECT COUNT(*) FILTER (WHERE severity = 'error') = 0 AS passed,
  COUNT(*) FILTER (WHERE severity = 'error') AS errors, COUNT(*) AS issues,
  (SELECT COUNT(*) FROM {0}) AS records
FROM ({1}) i"""


@query("batch_verdict", _VERDICT.format("candles_dirty", _CANDLE_RULES), ("candles_dirty",))
def batch_verdict(spark, sf_dir):
    return validate.batch_verdict(views.candles_dirty(spark, sf_dir), CANDLE)


@query(
    "batch_verdict_funding",
    _VERDICT.format("funding_dirty", _FUNDING_RULES),
    ("funding_dirty",),
)
def batch_verdict_funding(spark, sf_dir):
    return validate.batch_verdict(views.funding_dirty(spark, sf_dir), FUNDING)


@query(
    "issue_report",
    f"""
SELECT record_index, concat('[', upper(severity), '] ', code, ' candle[',
  CAST(record_index AS VARCHAR), '] field=', field, ': ', message) AS line
FROM ({_CANDLE_RULES}) i""",
    ("candles_dirty",),
)
def issue_report(spark, sf_dir):
    issues = validate.validate_candles(views.candles_dirty(spark, sf_dir))
    return validate.issue_lines(issues, CANDLE).drop("rule_ord")


@query(
    "issue_counts",
    f"SELECT code, severity, field, COUNT(*) AS issues FROM ({_CANDLE_RULES}) i "
    "GROUP BY code, severity, field",
    ("candles_dirty",),
)
def issue_counts(spark, sf_dir):
    return validate.issue_counts(validate.validate_candles(views.candles_dirty(spark, sf_dir)))


@query(
    "duplicate_rank",
    """
SELECT record_index, row_number() OVER (PARTITION BY exchange, symbol, timeframe, source, timestamp
  ORDER BY record_index) AS occurrence
FROM candles_dirty""",
    ("candles_dirty",),
)
def duplicate_rank(spark, sf_dir):
    ranked = validate.duplicate_rank(views.candles_dirty(spark, sf_dir), CANDLE)
    return ranked.select(validate.INDEX, "occurrence")


# A batch in which only some symbols are damaged.
_PARTLY = f"""
partly AS (
  SELECT * FROM candles_dirty WHERE symbol >= 'S7'
  UNION ALL SELECT {", ".join(CANDLE_FIELDS)}, record_index FROM candles_indexed WHERE symbol < 'S7'
),
faulty AS (
  SELECT DISTINCT exchange, symbol, timeframe FROM candles_dirty
  WHERE symbol >= 'S7' AND (timestamp LIKE '%/%' OR open = '1.2.3' OR volume IN (' ', '-5')
    OR record_index % 2 = 1 OR (high = '0.00' AND NOT (open = '0.00' AND close = '0.00'))
    OR length(close) > 30)
)"""


def _partly_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.candles_indexed(spark, sf_dir)
    damaged = views.damage_candles(rows.where(F.col("symbol") >= "S7"))
    return rows.where(F.col("symbol") < "S7").unionByName(damaged)


@query(
    "validated_ingest",
    f"""
WITH {_PARTLY}
SELECT {STORED_TEXT} FROM partly p WHERE NOT EXISTS (
  SELECT 1 FROM faulty f WHERE f.exchange = p.exchange AND f.symbol = p.symbol)""",
    ("candles_indexed", "candles_dirty"),
)
def ingest(spark, sf_dir):
    root = shared_dir(spark, "ingest")
    validated_ingest(_partly_damaged(spark, sf_dir), root, CANDLE, scope=SET)
    return result_strings(scan_candles(spark, root).drop("date"))


# --- merges ----------------------------------------------------------------------


@query("upsert_merge", "SELECT * FROM merged", ("merged",))
def upsert_merge(spark, sf_dir):
    return merge.upsert_merge(
        views.candles_raw(spark, sf_dir), views.candles_incoming(spark, sf_dir), CANDLE.key
    )


@query("change_merge", "SELECT * FROM merged", ("merged",))
def change_merge(spark, sf_dir):
    return merge.change_merge(
        views.candles_raw(spark, sf_dir), views.candles_incoming(spark, sf_dir), CANDLE.key
    )


_ACTIONS = """
SELECT s.*, i.exchange IS NOT NULL AS sent, i.open AS o, i.high AS h, i.low AS l, i.close AS c,
  i.volume AS v
FROM candles_raw s LEFT JOIN incoming i ON i.exchange = s.exchange AND i.symbol = s.symbol
  AND i.timeframe = s.timeframe AND i.source = s.source AND i.timestamp = s.timestamp"""
_NEW = """
SELECT * FROM incoming i WHERE NOT EXISTS (
  SELECT 1 FROM candles_raw s WHERE i.exchange = s.exchange AND i.symbol = s.symbol
    AND i.timeframe = s.timeframe AND i.source = s.source AND i.timestamp = s.timestamp)"""
_DIFFERS = "(open, high, low, close, volume) <> (o, h, l, c, v)"


@query(
    "merge_change_log",
    f"""
SELECT CASE WHEN NOT sent THEN 'keep' WHEN {_DIFFERS} THEN 'update' ELSE 'unchanged' END AS action,
  COUNT(*) AS rows
FROM ({_ACTIONS}) a GROUP BY 1
UNION ALL SELECT 'insert', COUNT(*) FROM ({_NEW}) n""",
    ("candles_raw", "incoming"),
)
def merge_change_log(spark, sf_dir):
    return merge.merge_change_log(
        views.candles_raw(spark, sf_dir), views.candles_incoming(spark, sf_dir), CANDLE.key
    )


@query(
    "partition_scoped_merge",
    f"""
SELECT exchange, timeframe, substr(timestamp, 1, 10) AS date FROM ({_ACTIONS}) a
WHERE sent AND {_DIFFERS}
UNION SELECT exchange, timeframe, substr(timestamp, 1, 10) FROM ({_NEW}) n""",
    ("candles_raw", "incoming"),
)
def partition_scoped_merge(spark, sf_dir):
    root = shared_dir(spark, "scoped")
    sinks.write_candles(views.candles(spark, sf_dir), root, incoming_unique=True)
    return sinks.write_candles(
        views.candles_incoming(spark, sf_dir), root, strategy=merge.CHANGES
    )


@query("write_candles", f"SELECT {STORED_TEXT} FROM merged", ("merged",))
def write_candles(spark, sf_dir):
    root = shared_dir(spark, "candles")
    sinks.write_candles(views.candles_raw(spark, sf_dir), root)
    sinks.write_candles(views.candles_incoming(spark, sf_dir), root)
    return result_strings(scan_candles(spark, root).drop("date"))


@query("write_funding", f"SELECT {STORED_FUNDING_TEXT} FROM funding_merged", ("funding_merged",))
def write_funding(spark, sf_dir):
    root = shared_dir(spark, "funding")
    sinks.write_funding(views.funding_raw(spark, sf_dir), root)
    sinks.write_funding(views.funding_incoming(spark, sf_dir), root, strategy=merge.CHANGES)
    return result_strings(scan_funding(spark, root).drop("date"))


@query(
    "ingest_marker",
    """
SELECT 'candle' AS data_type, exchange AS provider, symbol, timeframe, COUNT(*) AS records,
  TRUE AS marked
FROM candles_raw GROUP BY exchange, symbol, timeframe""",
    ("candles_raw",),
)
def ingest_marker(spark, sf_dir):
    root = shared_dir(spark, "marker")
    batch = views.candles_indexed(spark, sf_dir)
    validated_ingest(batch, root, CANDLE, mark=True)
    log = markers.ingest_log(spark, root)
    return log.withColumn("marked", F.col("ingested_at").isNotNull()).drop(
        "ingested_at", *markers.WRITER
    )


@query(
    "last_ingest",
    """
SELECT COUNT(DISTINCT (exchange, symbol, timeframe)) AS sets, TRUE AS is_last FROM candles_raw""",
    ("candles_raw",),
)
def last_ingest(spark, sf_dir):
    """The time of the last ingest against the log of two ingests."""
    root = shared_dir(spark, "marker")
    batch = views.candles_indexed(spark, sf_dir)
    for part in (batch.where("symbol < 'S5'"), batch):
        validated_ingest(part, root, CANDLE, mark=True)
    last = markers.last_ingest(spark, root)
    log = markers.ingest_log(spark, root).groupBy("run").agg(
        F.count(F.lit(1)).alias("sets"), F.max("ingested_at").alias("ingested_at")
    )
    newest = log.orderBy(F.desc("ingested_at"), F.desc("sets")).limit(1)
    return newest.join(F.broadcast(last), F.col("ingested_at") <= F.col("last_ingest")).select(
        "sets", (F.col("ingested_at") == F.col("last_ingest")).alias("is_last")
    )


# --- generated records -----------------------------------------------------------


@query(
    "synthetic_candles",
    """
SELECT event_id AS record_index, 'fake' AS exchange, 'BTC/USDT' AS symbol, '1h' AS timeframe,
  concat('2026-05-27T', lpad(CAST((event_id // 60) % 24 AS VARCHAR), 2, '0'), ':',
    lpad(CAST(event_id % 60 AS VARCHAR), 2, '0'), ':00') AS timestamp,
  CAST(100 + event_id % 50 AS VARCHAR) AS open, CAST(110 + event_id % 50 AS VARCHAR) AS high,
  CAST(90 + event_id % 30 AS VARCHAR) AS low, CAST(105 + event_id % 40 AS VARCHAR) AS close,
  CAST(10 + (event_id * 7) % 100 AS VARCHAR) AS volume, 'benchmark' AS source
FROM events""",
)
def synthetic_candles(spark, sf_dir):
    return synthetic.candles_by_index(table(spark, sf_dir, "events"), "event_id")


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.concat(F.lit("U"), F.col("user_id"), F.lit("/USDT")).alias("symbol"))
        .agg(F.date_trunc("second", F.min("ts")).cast("timestamp_ntz").alias("start"))
        .withColumn("timeframe", F.lit("1h"))
    )


_STARTS = """
WITH starts AS (
  SELECT concat('U', CAST(user_id AS VARCHAR), '/USDT') AS symbol,
    CAST(date_trunc('second', MIN(ts)) AS TIMESTAMP) AS start
  FROM events GROUP BY user_id)"""


@query(
    "synthetic_funding",
    _STARTS
    + """
SELECT 'fake' AS exchange, symbol, strftime(start, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  '0.0001' AS rate, '0.0002' AS predicted_rate,
  strftime(start + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') AS next_funding_time, 'fake' AS source
FROM starts""",
)
def synthetic_funding(spark, sf_dir):
    return synthetic.fake_funding(_starts(spark, sf_dir))


@query(
    "fake_candles",
    _STARTS
    + """
SELECT 'fake' AS exchange, symbol, '1h' AS timeframe,
  strftime(start, '%Y-%m-%dT%H:%M:%S') AS timestamp, '100' AS open, '110' AS high, '90' AS low,
  '105' AS close, '10' AS volume, 'fake' AS source
FROM starts""",
)
def fake_candles(spark, sf_dir):
    return synthetic.fake_candles(_starts(spark, sf_dir))


# --- payloads --------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str, exchange: str) -> DataFrame:
    return render(views.candles_raw(spark, sf_dir), exchange)


def _rendered(exchange: str, where: str = "TRUE") -> str:
    """The candles that a rendered exchange must give back."""

    def value(f: str) -> str:
        return f"regexp_replace({f}, '0$', '')" if exchange in BARE_NUMBERS else f

    # A bare 5.00 comes back as 5.0, as a JSON number has no trailing zeros.
    values = ", ".join(f"{value(f)} AS {f}" for f in CANDLE.decimals)
    return f"""
SELECT '{exchange}' AS exchange, concat(exchange, '.', symbol) AS symbol, timeframe, timestamp,
  {values}, '{exchange}' AS source
FROM candles_raw WHERE {where}"""


def _normaliser(exchange: str) -> None:
    @query(f"norm_{exchange}", _rendered(exchange), ("candles_raw",))
    def run(spark, sf_dir):
        return normalise.normalise(_pages(spark, sf_dir, exchange), [exchange])


for _name in normalise.FORMATS:
    _normaliser(_name)


@query(
    "landed_payloads",
    """
SELECT 'kucoin' AS exchange, concat(exchange, '.', symbol) AS symbol, timeframe,
  concat('{"code":"200000","data":[', string_agg(concat('["',
    CAST(CAST(epoch(CAST(timestamp AS TIMESTAMP)) AS BIGINT) AS VARCHAR), '","', open, '","', close,
    '","', high, '","', low, '","', volume, '","0"]'), ',' ORDER BY timestamp), ']}') AS body
FROM candles_raw GROUP BY exchange, symbol, timeframe, substr(timestamp, 1, 10)""",
    ("candles_raw",),
)
def landed(spark, sf_dir):
    root = shared_dir(spark, "landing")
    payloads.write_payloads(_pages(spark, sf_dir, "kucoin"), root)
    return payloads.landed_payloads(spark, root).select("exchange", "symbol", "timeframe", "body")


_CLIP = "timestamp >= '2024-01-04T06:00:00' AND timestamp < '2024-01-18T00:00:00'"


@query(
    "range_clip",
    f"{_rendered('kraken', _CLIP)} UNION ALL {_rendered('okx', _CLIP)}",
    ("candles_raw",),
)
def range_clip(spark, sf_dir):
    pages = _pages(spark, sf_dir, "kraken").unionByName(_pages(spark, sf_dir, "okx"))
    return normalise.normalise(pages, ["kraken", "okx"], "2024-01-04T06:00:00", "2024-01-18")


@query(
    "record_index",
    """
SELECT concat(exchange, '.', symbol) AS symbol, timestamp, row_number() OVER (
  PARTITION BY exchange, symbol, substr(timestamp, 1, 10) ORDER BY timestamp) - 1 AS position
FROM candles_raw""",
    ("candles_raw",),
)
def record_index(spark, sf_dir):
    parsed = normalise.parse_payloads(_pages(spark, sf_dir, "bybit"), ["bybit"])
    return normalise.payload_candles(parsed).select("symbol", "timestamp", "position")


@query(
    "epoch_to_iso",
    """
SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS from_seconds,
  strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') AS from_milliseconds
FROM events""",
)
def epoch_to_iso(spark, sf_dir):
    seconds = times.iso_to_epoch(F.col("ts"))
    milliseconds = seconds * 1000 + F.col("event_id") % 1000
    return table(spark, sf_dir, "events").select(
        "event_id",
        times.epoch_to_iso(seconds, "s").alias("from_seconds"),
        times.epoch_to_iso(milliseconds, "ms").alias("from_milliseconds"),
    )


_EXCHANGES = list(TIMEFRAME_CODES)
_TIMEFRAMES = sorted({p[1] for p in timeframe_pairs()}) + ["2y"]


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_NAMES = f"""
names AS (SELECT DISTINCT {_listed(_EXCHANGES)}[1 + event_id % {len(_EXCHANGES)}] AS exchange,
  concat(CASE user_id % 4 WHEN 0 THEN 'BTC' WHEN 1 THEN 'eth' WHEN 2 THEN 'tsla' ELSE 'Xrp-a' END,
    CAST(user_id % 50 AS VARCHAR), '/', CASE WHEN user_id % 3 = 0 THEN 'usdt' ELSE 'BTC' END)
    AS symbol,
  {_listed(_TIMEFRAMES)}[1 + user_id % {len(_TIMEFRAMES)}] AS timeframe
  FROM events)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")

    def pick(values, at):
        return F.try_element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))

    base = (
        F.when(user % 4 == 0, "BTC")
        .when(user % 4 == 1, "eth")
        .when(user % 4 == 2, "tsla")
        .otherwise("Xrp-a")
    )
    quote = F.when(user % 3 == 0, "usdt").otherwise("BTC")
    return (
        table(spark, sf_dir, "events")
        .select(
            pick(_EXCHANGES, F.col("event_id") % len(_EXCHANGES)).alias("exchange"),
            F.concat(base, (user % 50).cast("string"), F.lit("/"), quote).alias("symbol"),
            pick(_TIMEFRAMES, user % len(_TIMEFRAMES)).alias("timeframe"),
        )
        .distinct()
    )


@query(
    "symbol_to_native",
    f"""
WITH {_NAMES}
SELECT DISTINCT exchange, symbol, CASE
  WHEN exchange IN ('coinbase', 'okx') THEN upper(replace(symbol, '/', '-'))
  WHEN exchange = 'kucoin' THEN CASE WHEN contains(symbol, '-') THEN upper(symbol)
    ELSE upper(replace(symbol, '/', '-')) END
  WHEN exchange = 'gateio' THEN upper(replace(symbol, '/', '_'))
  WHEN exchange IN ('bybit', 'mexc', 'gemini') THEN upper(replace(symbol, '/', ''))
  WHEN exchange IN ('bitstamp', 'htx') THEN lower(replace(symbol, '/', ''))
  WHEN exchange = 'bitfinex' THEN CASE WHEN symbol LIKE 't%' THEN symbol
    ELSE concat('t', upper(replace(symbol, '/', ''))) END
  ELSE replace(upper(replace(symbol, '/', '')), 'BTC', 'XBT') END AS native_symbol
FROM names""",
)
def symbol_to_native(spark, sf_dir):
    native = native_symbol(F.col("exchange"), F.col("symbol")).alias("native_symbol")
    return _names(spark, sf_dir).select("exchange", "symbol", native).distinct()


_CODES = ", ".join(str(p) for p in timeframe_pairs())


@query(
    "timeframe_to_native",
    f"""
WITH {_NAMES},
codes(exchange, timeframe, native) AS (VALUES {_CODES}),
lists AS (SELECT exchange, string_agg(timeframe, ', ' ORDER BY timeframe) AS supported
  FROM codes GROUP BY exchange)
SELECT DISTINCT n.exchange, n.timeframe, c.native AS native_timeframe,
  CASE WHEN c.native IS NULL THEN concat('Unsupported timeframe ''', n.timeframe,
    '''. Supported: ', l.supported) END AS reason
FROM names n JOIN lists l ON l.exchange = n.exchange
LEFT JOIN codes c ON c.exchange = n.exchange AND c.timeframe = n.timeframe""",
)
def timeframe_to_native(spark, sf_dir):
    requests = normalise.native_requests(_names(spark, sf_dir))
    return requests.select("exchange", "timeframe", "native_timeframe", "reason").distinct()


@query(
    "decimal_normalise",
    """
SELECT event_id, CASE WHEN k = 0 THEN d ELSE rtrim(rtrim(concat(
  substr(p, 1, length(p) - k), '.', right(p, k)), '0'), '.') END AS plain, d AS untouched
FROM (SELECT *, lpad(d, CAST(greatest(length(d), k + 1) AS INTEGER), '0') AS p FROM (
  SELECT event_id, CAST(event_id % 9 AS INTEGER) AS k,
  CAST(CAST(ROUND(value * 100) AS BIGINT) + 1 AS VARCHAR) AS d FROM events) e) t""",
)
def decimal_normalise(spark, sf_dir):
    digits = (F.round(F.col("value") * 100).cast("long") + 1).cast("string")
    scientific = F.concat(digits, F.lit("e-"), (F.col("event_id") % 9).cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        text.plain_decimal(scientific).alias("plain"),
        text.plain_decimal(digits).alias("untouched"),
    )


def _damaged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page per set and day, of an exchange by symbol digit; some are broken.

    Days whose number is divisible by 5 are cut off, by 7 report an error, by 11 are
    empty.
    """
    day = F.substring("day", 9, 2).cast("int")
    digit = F.substring(F.substring_index("symbol", ".S", -1), 1, 1).cast("int")
    pages = None
    for i, name in enumerate(("kucoin", "okx", "kraken")):
        rendered = _pages(spark, sf_dir, name).where(digit % 3 == i)
        pages = rendered if pages is None else pages.unionByName(rendered)
    error = F.when(
        F.col("exchange") == "kraken", '{"error":["EGeneral:Busy"],"result":{}}'
    ).otherwise('{"code":"50001","data":[]}')
    empty = F.when(
        F.col("exchange") == "kraken", '{"error":[],"result":{"XPAIR":[],"last":0}}'
    ).otherwise(
        F.when(F.col("exchange") == "okx", '{"code":"0","data":[]}').otherwise(
            '{"code":"200000","data":[]}'
        )
    )
    body = (
        F.when(day % 5 == 0, F.substring(F.col("body"), F.lit(1), F.length("body") - 3))
        .when(day % 7 == 0, error)
        .when(day % 11 == 0, empty)
        .otherwise(F.col("body"))
    )
    return pages.withColumn("body", body)


# Pages as (exchange, symbol, day, rows, broken).
_PAGES = """
pages AS (
  SELECT *, CASE WHEN day % 5 = 0 OR day % 7 = 0 THEN 'rejected' WHEN day % 11 = 0 THEN 'empty'
    ELSE 'good' END AS state
  FROM (
    SELECT CASE CAST(substr(symbol, 2, 1) AS INTEGER) % 3 WHEN 0 THEN 'kucoin' WHEN 1 THEN 'okx'
        ELSE 'kraken' END AS exchange,
      concat(exchange, '.', symbol) AS symbol, CAST(substr(timestamp, 9, 2) AS INTEGER) AS day,
      substr(timestamp, 1, 10) AS full_day, COUNT(*) AS n
    FROM candles_raw GROUP BY ALL
  ) p
)"""


@query(
    "multi_symbol_ingest",
    f"""
WITH {_PAGES}
SELECT exchange, symbol, COUNT(*) AS payloads, COUNT(*) FILTER (WHERE state = 'rejected') AS rejected,
  CAST(COALESCE(SUM(CASE WHEN state = 'good' THEN n END), 0) AS BIGINT) AS candles,
  COUNT(*) FILTER (WHERE state = 'rejected') = 0 AS ok
FROM pages GROUP BY exchange, symbol""",
    ("candles_raw",),
)
def multi_symbol_ingest(spark, sf_dir):
    parsed = normalise.parse_payloads(_damaged_pages(spark, sf_dir), ["kucoin", "okx", "kraken"])
    return normalise.ingest_outcome(parsed)


@query(
    "payload_rejects",
    f"""
WITH {_PAGES}
SELECT exchange, symbol, full_day AS day,
  CASE WHEN day % 5 = 0 THEN 'INVALID_JSON' ELSE 'API_ERROR' END AS reason
FROM pages WHERE state = 'rejected'""",
    ("candles_raw",),
)
def payload_rejects(spark, sf_dir):
    parsed = normalise.parse_payloads(_damaged_pages(spark, sf_dir), ["kucoin", "okx", "kraken"])
    return normalise.payload_rejects(parsed).select("exchange", "symbol", "day", "reason")


@query(
    "payload_conformance",
    f"""
WITH {_PAGES},
probes AS (SELECT *, (day - 1) // 3 AS probe, (day - 1) % 3 + 1 AS attempt FROM pages)
SELECT exchange, symbol, CAST(probe AS INTEGER) AS probe,
  COUNT(*) FILTER (WHERE state = 'good') AS successes,
  COUNT(*) FILTER (WHERE state <> 'good') AS failures,
  COUNT(*) FILTER (WHERE state <> 'good') < 2 AS passed
FROM probes GROUP BY exchange, symbol, probe""",
    ("candles_raw",),
)
def payload_conformance(spark, sf_dir):
    day = F.substring("day", 9, 2).cast("int") - 1
    attempts = _damaged_pages(spark, sf_dir).withColumns(
        {"probe": F.floor(day / 3).cast("int"), "attempt": day % 3 + 1}
    )
    return normalise.payload_conformance(
        attempts, ["exchange", "symbol", "probe"], ["kucoin", "okx", "kraken"]
    )


_DRIFT = """
probes AS (SELECT page_id, requested_url, CASE page_id % 4 WHEN 0 THEN requested_url
    WHEN 1 THEN replace(requested_url, '/v1/', '/v2/')
    WHEN 2 THEN concat(requested_url, '&moved=1')
    ELSE url END AS final_url
  FROM (SELECT page_id, url, concat(url, '/api/v1/klines') AS requested_url FROM pages) u)"""


@query(
    "api_version_drift",
    f"""
WITH {_DRIFT}
SELECT page_id, CASE WHEN page_id % 4 = 1 THEN 'v2' ELSE 'unknown' END AS new_version,
  CASE page_id % 4 WHEN 1 THEN 'redirect'
    WHEN 3 THEN concat('redirect: ', requested_url, ' → ', final_url) ELSE '' END AS detected_via
FROM probes""",
)
def api_version_drift(spark, sf_dir):
    requested = F.concat(F.col("url"), F.lit("/api/v1/klines"))
    kind = F.col("page_id") % 4
    final = (
        F.when(kind == 0, requested)
        .when(kind == 1, F.replace(requested, F.lit("/v1/"), F.lit("/v2/")))
        .when(kind == 2, F.concat(requested, F.lit("&moved=1")))
        .otherwise(F.col("url"))
    )
    probes = table(spark, sf_dir, "pages").select(
        "page_id", requested.alias("requested_url"), final.alias("final_url")
    )
    drift = normalise.api_version_drift(probes)
    return drift.select("page_id", "new_version", "detected_via")


# --- scalar functions ------------------------------------------------------------


@query(
    "date_texts",
    """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(NULL AS VARCHAR) AS malformed,
  strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS parsed_day,
  strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%S') AS parsed_time
FROM orders""",
)
def date_texts(spark, sf_dir):
    day = F.substring(times.iso_text(F.col("o_orderdate")), 1, 10)
    parts = [F.split_part(day, F.lit("-"), F.lit(i)) for i in (3, 2, 1)]
    later = times.iso_text(F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTES"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.day_month_year_to_iso(F.concat_ws("/", *parts)).alias("iso"),
        text.day_month_year_to_iso(F.concat_ws("-", *parts)).alias("malformed"),
        times.iso_text(times.parse_either(day)).alias("parsed_day"),
        times.iso_text(times.parse_either(later)).alias("parsed_time"),
    )


# --- streaming -------------------------------------------------------------------


def _land(pages: DataFrame, root: str) -> None:
    payloads.write_payloads(pages, root)


def _follow(spark: SparkSession, landing: str, base: str, **options) -> None:
    running = follow(
        spark, landing, f"{base}/store", f"{base}/checkpoint", f"{base}/quarantine", **options
    )
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()


@query(
    "follow_ingest",
    f"SELECT {STORED_TEXT} FROM ({_rendered('bybit')}) r",
    ("candles_raw",),
)
def follow_ingest(spark, sf_dir):
    base = shared_dir(spark, "follow")
    _land(_pages(spark, sf_dir, "bybit"), f"{base}/landing")
    _follow(spark, f"{base}/landing", base)
    return result_strings(scan_candles(spark, f"{base}/store").drop("date"))


@query(
    "late_correction",
    f"""
SELECT {STORED_TEXT} FROM (
  SELECT exchange, symbol, timeframe, timestamp, open, high, low,
    CASE WHEN substr(timestamp, 12, 2) = '13' THEN high ELSE close END AS close, volume, source
  FROM ({_rendered('mexc')}) r) c""",
    ("candles_raw",),
)
def late_correction(spark, sf_dir):
    base = shared_dir(spark, "late")
    rows = views.candles_raw(spark, sf_dir)
    _land(render(rows, "mexc"), f"{base}/landing")
    _follow(spark, f"{base}/landing", base)
    # The same hours again later: hour 13 corrected, hour 15 unchanged.
    hour = F.substring("timestamp", 12, 2)
    corrected = rows.withColumn("close", F.when(hour == "13", F.col("high")).otherwise(F.col("close")))
    _land(render(corrected.where(hour.isin("13", "15")), "mexc"), f"{base}/landing")
    _follow(spark, f"{base}/landing", base, strategy=merge.CHANGES)
    return result_strings(scan_candles(spark, f"{base}/store").drop("date"))


@query(
    "stream_quarantine",
    f"""
WITH shown AS ({_rendered('gateio')}),
faulty AS (SELECT DISTINCT symbol FROM shown WHERE symbol LIKE '%.S3/%' AND timestamp LIKE '%T04:%'
  AND (open <> '0.00' OR close <> '0.00'))
SELECT exchange, symbol, COUNT(*) AS records, 'held' AS state FROM shown
WHERE symbol IN (SELECT symbol FROM faulty) GROUP BY exchange, symbol
UNION ALL
SELECT exchange, symbol, COUNT(*), 'stored' FROM shown
WHERE symbol NOT IN (SELECT symbol FROM faulty) GROUP BY exchange, symbol""",
    ("candles_raw",),
)
def stream_quarantine(spark, sf_dir):
    base = shared_dir(spark, "hold")
    rows = views.candles_raw(spark, sf_dir)
    low_high = (F.col("symbol") == "S3/USDT") & (F.substring("timestamp", 12, 2) == "04")
    rows = rows.withColumn("high", F.when(low_high, "0.00").otherwise(F.col("high")))
    _land(render(rows, "gateio"), f"{base}/landing")
    _follow(spark, f"{base}/landing", base)
    held = spark.read.parquet(f"{base}/quarantine/records")
    stored = scan(spark, f"{base}/store", CANDLE)
    both = held.select("exchange", "symbol", F.lit("held").alias("state")).unionByName(
        stored.select("exchange", "symbol", F.lit("stored").alias("state"))
    )
    return both.groupBy("exchange", "symbol", "state").agg(F.count(F.lit(1)).alias("records"))


@query(
    "incremental_backfill",
    f"""
WITH shown AS ({_rendered('kucoin')}),
last AS (SELECT symbol, MAX(timestamp) AS t FROM shown
  WHERE timestamp < '2024-01-15' AND symbol NOT LIKE '%.S9/%' GROUP BY symbol)
SELECT {STORED_TEXT} FROM shown WHERE symbol IN (SELECT symbol FROM last)""",
    ("candles_raw",),
)
def backfill(spark, sf_dir):
    base = shared_dir(spark, "backfill")
    pages = _pages(spark, sf_dir, "kucoin")
    payloads.write_payloads(pages, f"{base}/landing")
    landed_pages = payloads.landed_payloads(spark, f"{base}/landing")
    # Stored so far: the first half of January, and nothing of the S9 symbols.
    early = normalise.normalise(pages.where(~F.contains("symbol", F.lit(".S9/"))), ["kucoin"])
    sinks.write_candles(early.where(F.col("timestamp") < "2024-01-15"), f"{base}/store")
    requests = landed_pages.select("exchange", "symbol", "timeframe").distinct()
    incremental_backfill(spark, requests, landed_pages, f"{base}/store")
    return result_strings(scan_candles(spark, f"{base}/store").drop("date"))


# Symbols whose fourth hours are shown with a high below the rest, where that is a fault.
_FAULTY = """
shown AS ({rows}),
faulty AS (SELECT DISTINCT symbol FROM shown WHERE symbol LIKE '%.S{digit}/%'
  AND timestamp LIKE '%T04:%' AND (open <> '0.00' OR close <> '0.00'))"""


def _low_highs(rows: DataFrame, *symbols: str) -> DataFrame:
    low_high = F.col("symbol").isin(*symbols) & (F.substring("timestamp", 12, 2) == "04")
    return rows.withColumn("high", F.when(low_high, "0.00").otherwise(F.col("high")))


def _retried(spark: SparkSession, sf_dir: str) -> str:
    """Pages with faults in two symbols, then corrected fourth hours of one of them."""
    base = shared_dir(spark, "retry")
    rows = views.candles_raw(spark, sf_dir)
    _land(render(_low_highs(rows, "S3/USDT", "S4/USDT"), "gateio"), f"{base}/landing")
    _follow(spark, f"{base}/landing", base)
    fourth = (F.col("symbol") == "S3/USDT") & (F.substring("timestamp", 12, 2) == "04")
    _land(render(rows.where(fourth), "gateio"), f"{base}/landing")
    _follow(spark, f"{base}/landing", base)
    return base


@query(
    "retry_held_sets",
    f"""
WITH {_FAULTY.format(rows=_rendered('gateio'), digit=4)}
SELECT {STORED_TEXT} FROM shown WHERE symbol NOT IN (SELECT symbol FROM faulty)""",
    ("candles_raw",),
)
def retry_held_sets(spark, sf_dir):
    """Held sets whose faulty hours come again are stored whole; the others stay out."""
    base = _retried(spark, sf_dir)
    return result_strings(scan_candles(spark, f"{base}/store").drop("date"))


@query(
    "retry_ledger",
    f"""
WITH {_FAULTY.format(rows=_rendered('gateio'), digit=4)},
solved AS (SELECT DISTINCT symbol FROM shown WHERE symbol LIKE '%.S3/%'
  AND timestamp LIKE '%T04:%' AND (open <> '0.00' OR close <> '0.00'))
SELECT 'gateio' AS exchange, symbol, '1h' AS timeframe, 'VALIDATION' AS reason, 1 AS attempts,
  'open' AS state FROM faulty
UNION ALL
SELECT 'gateio', symbol, '1h', 'VALIDATION', 1, 'solved' FROM solved""",
    ("candles_raw",),
)
def retry_ledger(spark, sf_dir):
    side = f"{_retried(spark, sf_dir)}/quarantine"
    parts = [
        rows.select("exchange", "symbol", "timeframe", "reason", "attempts", F.lit(state).alias("state"))
        for rows, state in ((open_failures(spark, side), "open"), (solved_failures(spark, side), "solved"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "follow_since_last",
    f"""
WITH shown AS ({_rendered('kucoin')}),
last AS (SELECT symbol, MAX(timestamp) AS t FROM shown
  WHERE timestamp < '2024-01-15' AND symbol NOT LIKE '%.S9/%' GROUP BY symbol)
SELECT {STORED_TEXT} FROM shown WHERE symbol IN (SELECT symbol FROM last)""",
    ("candles_raw",),
)
def since_last(spark, sf_dir):
    """The backfill as a stream that is started twice, with new pages in between."""
    base = shared_dir(spark, "since")
    rows = views.candles_raw(spark, sf_dir)
    early = normalise.normalise(
        render(rows.where(~F.startswith("symbol", F.lit("S9/"))), "kucoin"), ["kucoin"]
    )
    sinks.write_candles(early.where(F.col("timestamp") < "2024-01-15"), f"{base}/store")
    for days in (F.col("timestamp") < "2024-01-20", F.col("timestamp") >= "2024-01-20"):
        _land(render(rows.where(days), "kucoin"), f"{base}/landing")
        landed_pages = payloads.landed_payloads(spark, f"{base}/landing")
        running = follow_since_last(
            spark,
            landed_pages.select("exchange", "symbol", "timeframe").distinct(),
            f"{base}/landing",
            f"{base}/store",
            f"{base}/checkpoint",
            f"{base}/quarantine",
        )
        running.awaitTermination()
        if running.exception() is not None:
            raise running.exception()
    return result_strings(scan_candles(spark, f"{base}/store").drop("date"))
