"""Market-data views over the given tables, in Spark and as SQL text.

The tables have no candles. Hourly candles, daily funding rates and run stages are
derived from ``events`` and ``lineitem``; the SQL text gives the same rows in any
engine and is what results are checked against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.times import iso_text
from tickloom.operators.cast import typed_cast
from tickloom.operators.validate import INDEX
from tickloom.schemas import CANDLE, CANDLE_FIELDS, FUNDING, FUNDING_FIELDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hundredths(value: Column) -> Column:
    """Integer hundredths -> decimal text with two digits."""
    return F.concat(
        F.floor(value / 100).cast("string"),
        F.lit("."),
        F.lpad((value % 100).cast("string"), 2, "0"),
    )


def _ticks(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("exchange"),
        F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string"), F.lit("/USDT")).alias(
            "symbol"
        ),
        F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("b"),
        "ts",
        "event_id",
        F.round(F.col("value") * 100).cast("long").alias("c"),
    )


def candles_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly candles as text, with a distinct even ``record_index``."""
    at = F.struct("ts", "event_id")
    bars = (
        _ticks(spark, sf_dir, "hour")
        .groupBy("exchange", "symbol", "b")
        .agg(
            F.min_by("c", at).alias("open"),
            F.max("c").alias("high"),
            F.min("c").alias("low"),
            F.max_by("c", at).alias("close"),
            F.sum("c").alias("volume"),
            F.min("event_id").alias("e"),
        )
    )
    return bars.select(
        "exchange",
        "symbol",
        F.lit("1h").alias("timeframe"),
        iso_text(F.col("b")).alias("timestamp"),
        *[_hundredths(F.col(f)).alias(f) for f in CANDLE.decimals],
        F.col("exchange").alias("source"),
        (F.col("e") * 2).alias(INDEX),
    )


def candles_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles_indexed(spark, sf_dir).select(*CANDLE_FIELDS)


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_cast(candles_raw(spark, sf_dir), CANDLE)


def _hour() -> Column:
    return F.substring("timestamp", 12, 2)


def damage_candles(rows: DataFrame) -> DataFrame:
    """Faults by hour of day: blank volume, bad open, negative volume, low high,
    bad time shape, too many digits; hour 07 is sent twice."""
    hour = _hour()
    damaged = rows.withColumns(
        {
            "open": F.when(hour == "02", "1.2.3").otherwise(F.col("open")),
            "high": F.when(hour == "04", "0.00").otherwise(F.col("high")),
            "close": F.when(hour == "06", "9" * 39 + ".0").otherwise(F.col("close")),
            "volume": F.when(hour == "01", " ")
            .when(hour == "03", "-5")
            .otherwise(F.col("volume")),
            "timestamp": F.when(
                hour == "05",
                F.concat(
                    F.replace(F.substring("timestamp", 1, 10), F.lit("-"), F.lit("/")),
                    F.substring("timestamp", 11, 9),
                ),
            ).otherwise(F.col("timestamp")),
        }
    )
    again = rows.where(hour == "07").withColumn(INDEX, F.col(INDEX) + 1)
    return damaged.unionByName(again)


def candles_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_candles(candles_indexed(spark, sf_dir))


def _signed_rate(value: Column) -> Column:
    sign = F.when(value < 0, "-").otherwise("")
    return F.concat(sign, F.lit("0."), F.lpad(F.abs(value).cast("string"), 5, "0"))


def funding_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily funding rates as text; rates span ±0.0065."""
    days = (
        _ticks(spark, sf_dir, "day")
        .groupBy("exchange", "symbol", "b")
        .agg(F.min("event_id").alias("e"))
    )
    return days.select(
        "exchange",
        "symbol",
        iso_text(F.col("b")).alias("timestamp"),
        _signed_rate((F.col("e") * 37) % 1301 - 650).alias("rate"),
        _signed_rate((F.col("e") * 53) % 1301 - 650).alias("predicted_rate"),
        iso_text(F.col("b") + F.expr("INTERVAL 8 HOURS")).alias("next_funding_time"),
        F.col("exchange").alias("source"),
        (F.col("e") * 2).alias(INDEX),
    )


def funding_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funding_indexed(spark, sf_dir).select(*FUNDING_FIELDS)


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_cast(funding_raw(spark, sf_dir), FUNDING)


def funding_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults by day of month; day 08 is sent twice."""
    rows = funding_indexed(spark, sf_dir)
    day = F.substring("timestamp", 9, 2)
    damaged = rows.withColumns(
        {
            "rate": F.when(day == "02", "abc").otherwise(F.col("rate")),
            "predicted_rate": F.when(day == "03", "9" * 39).otherwise(F.col("predicted_rate")),
            "next_funding_time": F.when(day == "04", F.col("timestamp"))
            .when(day == "05", "2024/01/05")
            .when(day == "07", "")
            .otherwise(F.col("next_funding_time")),
            "source": F.when(day == "06", " ").otherwise(F.col("source")),
        }
    )
    again = rows.where(day == "08").withColumn(INDEX, F.col(INDEX) + 1)
    return damaged.unionByName(again)


def candles_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch: the afternoon again, hour 13 corrected, hour 14 of a new source."""
    hour = _hour()
    return candles_raw(spark, sf_dir).where(hour >= "12").withColumns(
        {
            "close": F.when(hour == "13", F.col("high")).otherwise(F.col("close")),
            "source": F.when(hour == "14", "replay").otherwise(F.col("source")),
        }
    )


def funding_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch: days from the 10th again, the 11th corrected, the 12th new."""
    day = F.substring("timestamp", 9, 2)
    return funding_raw(spark, sf_dir).where(day >= "10").withColumns(
        {
            "rate": F.when(day == "11", "0.00011").otherwise(F.col("rate")),
            "source": F.when(day == "12", "replay").otherwise(F.col("source")),
        }
    )


# Stage names by line number.
STAGES = (
    "Candle creation",
    "Decimal cast",
    "Column conversion",
    "Validation",
    "Timestamp cast",
    "Parquet write",
    "Read back",
)


def run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage rows: an order is a run, its lines are stages; whole-numbered doubles."""

    def hundredths(name: str) -> Column:
        return F.round(F.col(name) * 100).cast("long")

    price = F.max(F.round("l_extendedprice").cast("long")).cast("double")
    line = F.col("l_linenumber")
    names = F.array(*[F.lit(s) for s in STAGES])
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.sum(hundredths("l_quantity")).cast("double").alias("wall_ms"),
            F.sum(hundredths("l_quantity") - hundredths("l_discount") * 50)
            .cast("double")
            .alias("cpu_ms"),
            F.sum(hundredths("l_tax") - 2).cast("double").alias("mem_delta_mb"),
            price.alias("peak_mb"),
            (F.max("l_suppkey") % 3).cast("long").alias("gc_g2"),
        )
        .select(
            F.col("l_orderkey").alias("run_id"),
            F.concat(F.lit("r"), (F.col("l_orderkey") % 20).cast("string")).alias("runner"),
            (F.col("l_orderkey") % 7 * 1000).alias("count"),
            (line - 1).cast("long").alias("stage_no"),
            F.try_element_at(names, line).alias("stage"),
            "wall_ms",
            "cpu_ms",
            "mem_delta_mb",
            "peak_mb",
            "gc_g2",
            F.when(line == 6, F.col("peak_mb")).alias("file_kb"),
            F.lit(5).cast("long").alias("pipeline_end"),
        )
    )


def run_pairs(stages: DataFrame) -> DataFrame:
    """Every run with the run of the next number, where there is one."""
    runs = stages.select("run_id").distinct()
    following = runs.select((F.col("run_id") - 1).alias("run_id"))
    return runs.join(following, "run_id", "left_semi").select(
        F.col("run_id").alias("pair_id"),
        F.col("run_id").alias("run_a"),
        (F.col("run_id") + 1).alias("run_b"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log records with nested stages; a run has one stage per line number."""
    stages = run_stages(spark, sf_dir)
    ms = ("wall_ms", "cpu_ms", "mem_delta_mb", "peak_mb")
    stage = F.struct(
        "stage_no",
        F.col("stage").alias("name"),
        *ms,
        F.lit(0).cast("long").alias("gc_g0"),
        F.lit(0).cast("long").alias("gc_g1"),
        "gc_g2",
        "file_kb",
    )
    metric = "struct<median:double,ci_lo:double,ci_hi:double>"
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    zero = F.lit(0)
    runs = stages.groupBy("run_id", "runner", "count").agg(
        F.sort_array(F.collect_list(stage)).alias("s"),
        F.sum("wall_ms").alias("wall"),
        F.sum("cpu_ms").alias("cpu"),
    )
    nothing = F.lit(None).cast("double")

    def median(value: str) -> Column:
        return F.struct(
            F.col(value).alias("median"), nothing.alias("ci_lo"), nothing.alias("ci_hi")
        ).cast(metric)

    seconds = F.make_dt_interval(zero, zero, zero, F.col("run_id").cast("decimal(18,6)"))
    return runs.select(
        iso_text(start + seconds).alias("timestamp"),
        "runner",
        "count",
        F.lit(1).cast("long").alias("iterations"),
        F.lit("s").alias("ts_resolution"),
        F.create_map(
            F.lit("wall_ms"), median("wall"), F.lit("cpu_ms"), median("cpu")
        ).alias("summary"),
        F.transform("s", lambda x: x.dropFields("stage_no")).alias("stage_breakdown"),
        F.array().cast("array<struct<name:string,rating:string,message:string>>").alias("rules"),
        F.concat(F.lit("sha"), F.lpad(F.col("run_id").cast("string"), 7, "0")).alias("git_sha"),
        F.lit("main").alias("git_ref"),
    )


# --- the same views as SQL text -------------------------------------------------

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S')"


def _money(name: str) -> str:
    return (
        f"concat(CAST({name} // 100 AS STRING), '.', "
        f"lpad(CAST({name} % 100 AS STRING), 2, '0'))"
    )


def _rate(name: str) -> str:
    return (
        f"concat(CASE WHEN {name}<0 THEN '-' ELSE '' END, '0.', "
        f"lpad(CAST(abs({name}) AS STRING), 5, '0'))"
    )


_FIELDS = ", ".join(CANDLE_FIELDS)
_FUNDING = ", ".join(FUNDING_FIELDS)

SQL_VIEWS: dict[str, str] = {
    "candles_indexed": f"""
SELECT exchange, symbol, '1h' AS timeframe, {_ISO.format('b')} AS timestamp,
  {_money('oc')} AS open, {_money('hc')} AS high, {_money('lc')} AS low,
  {_money('cc')} AS close, {_money('vc')} AS volume, exchange AS source,
  2 * e AS record_index
FROM (
  SELECT exchange, symbol, b, MAX(CASE WHEN rf = 1 THEN c END) AS oc, MAX(c) AS hc, MIN(c) AS lc,
    MAX(CASE WHEN rl = 1 THEN c END) AS cc, CAST(SUM(c) AS BIGINT) AS vc, MIN(event_id) AS e
  FROM (
    SELECT *, row_number() OVER (PARTITION BY exchange, symbol, b ORDER BY ts, event_id) AS rf,
      row_number() OVER (PARTITION BY exchange, symbol, b ORDER BY ts DESC, event_id DESC) AS rl
    FROM (
      SELECT event_type AS exchange, concat('S', CAST(user_id % 10 AS STRING), '/USDT') AS symbol,
        CAST(date_trunc('hour', ts) AS TIMESTAMP) AS b, ts, event_id,
        CAST(ROUND(value * 100) AS BIGINT) AS c
      FROM events
    ) t
  ) n
  GROUP BY exchange, symbol, b
) g""",
    "candles_raw": f"SELECT {_FIELDS} FROM candles_indexed",
    "candles": "SELECT exchange, symbol, timeframe, CAST(timestamp AS TIMESTAMP) AS timestamp, "
    + ", ".join(f"CAST({f} AS DECIMAL(38,10)) AS {f}" for f in CANDLE.decimals)
    + ", source FROM candles_raw",
    "candles_dirty": f"""
SELECT exchange, symbol, timeframe,
  CASE WHEN hh = '05' THEN concat(replace(substr(timestamp, 1, 10), '-', '/'),
    substr(timestamp, 11, 9)) ELSE timestamp END AS timestamp,
  CASE WHEN hh = '02' THEN '1.2.3' ELSE open END AS open,
  CASE WHEN hh = '04' THEN '0.00' ELSE high END AS high, low,
  CASE WHEN hh = '06' THEN concat(repeat('9', 39), '.0') ELSE close END AS close,
  CASE WHEN hh = '01' THEN ' ' WHEN hh = '03' THEN '-5' ELSE volume END AS volume,
  source, record_index
FROM (SELECT *, substr(timestamp, 12, 2) AS hh FROM candles_indexed) k
UNION ALL
SELECT {_FIELDS}, record_index + 1 FROM candles_indexed WHERE substr(timestamp, 12, 2) = '07'""",
    "funding_indexed": f"""
SELECT exchange, symbol, {_ISO.format('b')} AS timestamp, {_rate('u')} AS rate,
  {_rate('w')} AS predicted_rate, {_ISO.format('b + INTERVAL 8 HOUR')} AS next_funding_time,
  exchange AS source, 2 * e AS record_index
FROM (
  SELECT *, (e * 37) % 1301 - 650 AS u, (e * 53) % 1301 - 650 AS w
  FROM (
    SELECT event_type AS exchange, concat('S', CAST(user_id % 10 AS STRING), '/USDT') AS symbol,
      CAST(date_trunc('day', ts) AS TIMESTAMP) AS b, MIN(event_id) AS e
    FROM events GROUP BY ALL
  ) n
) r""",
    "funding_raw": f"SELECT {_FUNDING} FROM funding_indexed",
    "funding": """
SELECT exchange, symbol, CAST(timestamp AS TIMESTAMP) AS timestamp,
  CAST(rate AS DECIMAL(38,10)) AS rate, CAST(predicted_rate AS DECIMAL(38,10)) AS predicted_rate,
  CAST(next_funding_time AS TIMESTAMP) AS next_funding_time, source
FROM funding_raw""",
    "funding_dirty": f"""
SELECT exchange, symbol, timestamp, CASE WHEN dd = '02' THEN 'abc' ELSE rate END AS rate,
  CASE WHEN dd = '03' THEN repeat('9', 39) ELSE predicted_rate END AS predicted_rate,
  CASE WHEN dd = '04' THEN timestamp WHEN dd = '05' THEN '2024/01/05' WHEN dd = '07' THEN ''
    ELSE next_funding_time END AS next_funding_time,
  CASE WHEN dd = '06' THEN ' ' ELSE source END AS source, record_index
FROM (SELECT *, substr(timestamp, 9, 2) AS dd FROM funding_indexed) k
UNION ALL
SELECT {_FUNDING}, record_index + 1 FROM funding_indexed WHERE substr(timestamp, 9, 2) = '08'""",
    "incoming": """
SELECT exchange, symbol, timeframe, timestamp, open, high, low,
  CASE WHEN substr(timestamp, 12, 2) = '13' THEN high ELSE close END AS close, volume,
  CASE WHEN substr(timestamp, 12, 2) = '14' THEN 'replay' ELSE source END AS source
FROM candles_raw WHERE substr(timestamp, 12, 2) >= '12'""",
    "funding_incoming": """
SELECT exchange, symbol, timestamp,
  CASE WHEN substr(timestamp, 9, 2) = '11' THEN '0.00011' ELSE rate END AS rate,
  predicted_rate, next_funding_time,
  CASE WHEN substr(timestamp, 9, 2) = '12' THEN 'replay' ELSE source END AS source
FROM funding_raw WHERE substr(timestamp, 9, 2) >= '10'""",
    "merged": """
SELECT * FROM candles_raw s WHERE NOT EXISTS (
  SELECT 1 FROM incoming i WHERE i.exchange = s.exchange AND i.symbol = s.symbol
    AND i.timeframe = s.timeframe AND i.source = s.source AND i.timestamp = s.timestamp)
UNION ALL SELECT * FROM incoming""",
    "funding_merged": """
SELECT * FROM funding_raw s WHERE NOT EXISTS (
  SELECT 1 FROM funding_incoming i WHERE i.exchange = s.exchange AND i.symbol = s.symbol
    AND i.source = s.source AND i.timestamp = s.timestamp)
UNION ALL SELECT * FROM funding_incoming""",
    "run_stages": """
SELECT l_orderkey AS run_id, concat('r', CAST(l_orderkey % 20 AS STRING)) AS runner,
  l_orderkey % 7 * 1000 AS count, CAST(l_linenumber - 1 AS BIGINT) AS stage_no,
  CASE l_linenumber """
    + " ".join(f"WHEN {i + 1} THEN '{s}'" for i, s in enumerate(STAGES))
    + """ END AS stage,
  CAST(SUM(CAST(ROUND(l_quantity * 100) AS BIGINT)) AS DOUBLE) AS wall_ms,
  CAST(SUM(CAST(ROUND(l_quantity * 100) AS BIGINT) - CAST(ROUND(l_discount * 100) AS BIGINT) * 50)
    AS DOUBLE) AS cpu_ms,
  CAST(SUM(CAST(ROUND(l_tax * 100) AS BIGINT) - 2) AS DOUBLE) AS mem_delta_mb,
  CAST(MAX(CAST(ROUND(l_extendedprice) AS BIGINT)) AS DOUBLE) AS peak_mb,
  CAST(MAX(l_suppkey) % 3 AS BIGINT) AS gc_g2,
  CASE WHEN l_linenumber = 6 THEN CAST(MAX(CAST(ROUND(l_extendedprice) AS BIGINT)) AS DOUBLE) END
    AS file_kb,
  CAST(5 AS BIGINT) AS pipeline_end
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "run_totals": """
SELECT *, CASE WHEN wall_ms > 0 THEN cpu_ms / wall_ms ELSE 0 END AS cpu_wall_ratio FROM (
  SELECT run_id, runner, count,
    COALESCE(SUM(CASE WHEN stage_no <= pipeline_end THEN wall_ms END), 0) AS wall_ms,
    COALESCE(SUM(CASE WHEN stage_no <= pipeline_end THEN cpu_ms END), 0) AS cpu_ms,
    COALESCE(SUM(CASE WHEN stage_no <= pipeline_end THEN GREATEST(mem_delta_mb, 0) END), 0)
      AS mem_mb,
    MAX(peak_mb) AS peak_mb, COALESCE(MAX(file_kb), 0) AS file_kb,
    CAST(COALESCE(SUM(CASE WHEN stage_no <= pipeline_end THEN gc_g2 END), 0) AS BIGINT) AS gc_g2,
    COALESCE(MAX(CASE WHEN stage = 'Parquet write' THEN wall_ms END), 0) AS write_ms,
    COALESCE(MAX(file_kb), 0) AS last_file_kb,
    COALESCE(SUM(CASE WHEN lower(stage) LIKE '%cast%' OR lower(stage) LIKE '%valid%'
      THEN wall_ms END), 0) AS validation_ms,
    COALESCE(SUM(CASE WHEN lower(stage) LIKE '%cast%' OR lower(stage) LIKE '%conversion%'
      THEN wall_ms END), 0) AS conversion_ms
  FROM run_stages GROUP BY run_id, runner, count
) s""",
    "run_pairs": """
SELECT DISTINCT run_id AS pair_id, run_id AS run_a, run_id + 1 AS run_b FROM run_stages
WHERE run_id + 1 IN (SELECT run_id FROM run_stages)""",
}

# Views each view reads, in the order they have to be defined.
_NEEDS = {
    "candles_raw": ("candles_indexed",),
    "candles": ("candles_raw",),
    "candles_dirty": ("candles_indexed",),
    "funding_raw": ("funding_indexed",),
    "funding": ("funding_raw",),
    "funding_dirty": ("funding_indexed",),
    "incoming": ("candles_raw",),
    "funding_incoming": ("funding_raw",),
    "merged": ("candles_raw", "incoming"),
    "funding_merged": ("funding_raw", "funding_incoming"),
    "run_totals": ("run_stages",),
    "run_pairs": ("run_stages",),
}


# Views that statements use many times, each of which would compute them anew.
_SHARED = ("run_stages", "run_totals")


def sql_over(views: tuple[str, ...], body: str) -> str:
    """A complete statement: the views it needs as CTEs, then the body."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(
        f"{name} AS {'MATERIALIZED ' if name in _SHARED else ''}({SQL_VIEWS[name].strip()})"
        for name in ordered
    )
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
