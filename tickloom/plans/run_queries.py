"""Queries over run stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.times import iso_text, step_after, timeframe_lengths
from tickloom.operators import logged, runs
from tickloom.plans import views
from tickloom.plans.catalog import query
from tickloom.session import shared_dir
from tickloom.sources import runlog


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_summary(views.run_stages(spark, sf_dir))


@query("run_summary", "SELECT * FROM run_totals", ("run_totals",))
def run_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


_T = " ".join(f"WHEN {df} THEN {t}" for df, t in runs.T_VALUES.items())


@query(
    "run_ci",
    f"""
SELECT runner, n AS iterations, median, CASE WHEN n < 3 THEN median ELSE round(mean - margin, 4) END
    AS ci_lo, CASE WHEN n < 3 THEN median ELSE round(mean + margin, 4) END AS ci_hi
FROM (
  SELECT *, CAST(CASE n - 1 {_T} ELSE {runs.T_OTHERWISE} END AS DOUBLE) * sd / sqrt(n) AS margin
  FROM (SELECT runner, COUNT(*) AS n, median(wall_ms) AS median, AVG(wall_ms) AS mean,
    stddev_samp(wall_ms) AS sd FROM run_totals GROUP BY runner) a) b""",
    ("run_totals",),
)
def run_ci(spark, sf_dir):
    found = runs.run_ci(_summary(spark, sf_dir), "wall_ms")
    return found.withColumns({c: F.round(c, 4) for c in ("ci_lo", "ci_hi")})


@query(
    "median_run",
    """
SELECT runner, median_wall_ms, run_id, wall_ms FROM (
  SELECT t.runner, m.median_wall_ms, t.run_id, t.wall_ms, row_number() OVER (PARTITION BY t.runner
    ORDER BY abs(t.wall_ms - m.median_wall_ms), t.run_id) AS rn
  FROM run_totals t JOIN (SELECT runner, median(wall_ms) AS median_wall_ms FROM run_totals
    GROUP BY runner) m ON m.runner = t.runner) r
WHERE rn = 1""",
    ("run_totals",),
)
def median_run(spark, sf_dir):
    return runs.median_run(_summary(spark, sf_dir))


_TREND = """
SELECT runner, run_id, row_number() OVER w - 1 AS index, cpu_ms AS value,
  (cpu_ms - lag(cpu_ms) OVER w) / nullif(abs(lag(cpu_ms) OVER w), 0) AS pct
FROM {} WINDOW w AS (PARTITION BY runner ORDER BY run_id)"""


@query(
    "run_trend",
    f"SELECT *, COALESCE(abs(pct) > 0.05, FALSE) AS flagged FROM ({_TREND.format('run_totals')}) t",
    ("run_totals",),
)
def run_trend(spark, sf_dir):
    return runs.run_trend(_summary(spark, sf_dir), "cpu_ms", "run_id")


@query(
    "run_trend_last",
    f"""
WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY runner
  ORDER BY run_id DESC) AS rn FROM run_totals) r WHERE rn <= 10)
SELECT *, COALESCE(abs(pct) > 0.05, FALSE) AS flagged FROM ({_TREND.format('latest')}) t""",
    ("run_totals",),
)
def run_trend_last(spark, sf_dir):
    return runs.run_trend(_summary(spark, sf_dir), "cpu_ms", "run_id", last=10)


def _cumulative(m: str, value: str) -> str:
    inside = "stage_no <= pipeline_end"
    return (
        f"SUM({value}) OVER w AS cum_{m}, "
        f"SUM(CASE WHEN {inside} THEN {value} END) OVER (PARTITION BY run_id) AS total_{m}"
    )


def _share(m: str) -> str:
    return (
        f"CASE WHEN total_{m} > 0 THEN CASE WHEN stage_no <= pipeline_end THEN cum_{m} ELSE 0 END "
        f"/ total_{m} * 100 END AS {m}_share"
    )


@query(
    "stage_cumulative",
    f"""
SELECT run_id, stage_no, stage, cum_wall, cum_cpu, cum_mem, {_share('wall')}, {_share('cpu')},
  {_share('mem')}
FROM (
  SELECT *, {_cumulative('wall', 'wall_ms')}, {_cumulative('cpu', 'cpu_ms')},
    {_cumulative('mem', 'GREATEST(mem_delta_mb, 0)')}
  FROM run_stages WINDOW w AS (PARTITION BY run_id ORDER BY stage_no)) s""",
    ("run_stages",),
)
def stage_cumulative(spark, sf_dir):
    return runs.stage_cumulative(views.run_stages(spark, sf_dir))


_TALL = " UNION ALL ".join(
    f"SELECT p.pair_id, '{m}' AS metric, CAST(a.{m} AS DOUBLE) AS old, CAST(b.{m} AS DOUBLE) AS new "
    "FROM run_pairs p JOIN run_totals a ON a.run_id = p.run_a "
    "JOIN run_totals b ON b.run_id = p.run_b"
    for m in runs.METRICS
)
_FAILS = " OR ".join(f"(metric = '{m}' AND pct > {v})" for m, v in runs.FAIL_ABOVE.items())
_WARNS = " OR ".join(f"(metric = '{m}' AND pct > {v})" for m, v in runs.WARN_ABOVE.items())
_CHANGES = f"""
SELECT *, CASE WHEN {_FAILS} THEN 'FAIL' WHEN {_WARNS}
  OR (metric = 'gc_g2' AND old = 0 AND new > 0) THEN 'WARN' ELSE 'PASS' END AS verdict
FROM (SELECT *, (new - old) / nullif(abs(old), 0) AS pct FROM ({_TALL}) t) c"""


_GROWTH = "printf('%+.1f%%', round(pct * 100, 1))"
_LABELS = " ".join(f"WHEN '{m}' THEN '{label}'" for m, label in runs.LABELS.items())


@query(
    "run_compare",
    f"""
SELECT *, CASE metric {_LABELS} END AS label,
  CASE WHEN {_FAILS} OR {_WARNS} THEN 'regressed ' || {_GROWTH}
    WHEN metric = 'gc_g2' AND old = 0 AND new > 0
    THEN printf('GC gen-2 appeared: %d → %d', CAST(old AS BIGINT), CAST(new AS BIGINT))
    ELSE '' END AS reason
FROM ({_CHANGES}) v""",
    ("run_totals", "run_pairs"),
)
def run_compare(spark, sf_dir):
    stages = views.run_stages(spark, sf_dir)
    changes = runs.metric_changes(runs.run_summary(stages), views.run_pairs(stages))
    return changes.select(
        "pair_id", "metric", "old", "new", "pct", "verdict", "label", "reason"
    )


@query(
    "regression_verdict",
    f"""
SELECT metric, verdict, COUNT(*) AS pairs FROM ({_CHANGES}) c GROUP BY metric, verdict""",
    ("run_totals", "run_pairs"),
)
def regression_verdict(spark, sf_dir):
    stages = views.run_stages(spark, sf_dir)
    changes = runs.metric_changes(runs.run_summary(stages), views.run_pairs(stages))
    return changes.groupBy("metric", "verdict").agg(F.count(F.lit(1)).alias("pairs"))


_STAGE_CHANGES = """
SELECT pair_id, stage, COALESCE(MAX(CASE WHEN NOT newer THEN wall_ms END), 0) AS old_wall,
  COALESCE(MAX(CASE WHEN newer THEN wall_ms END), 0) AS new_wall
FROM (
  SELECT p.pair_id, s.stage, FALSE AS newer, s.wall_ms FROM run_pairs p
    JOIN run_stages s ON s.run_id = p.run_a
  UNION ALL
  SELECT p.pair_id, s.stage, TRUE, s.wall_ms FROM run_pairs p
    JOIN run_stages s ON s.run_id = p.run_b
) b GROUP BY pair_id, stage"""


@query(
    "key_union",
    f"SELECT *, new_wall - old_wall AS delta FROM ({_STAGE_CHANGES}) s",
    ("run_stages", "run_pairs"),
)
def key_union(spark, sf_dir):
    stages = views.run_stages(spark, sf_dir)
    return runs.stage_changes(stages, views.run_pairs(stages))


@query(
    "top_stage_deltas",
    f"""
SELECT pair_id, stage, old_wall, new_wall, delta, rank,
  COALESCE(printf('%+.1f%%', round((new_wall - old_wall) / nullif(abs(old_wall), 0) * 100, 1)), 'new')
    AS pct_text
FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY abs(delta) DESC, stage) AS INTEGER)
    AS rank
  FROM (SELECT *, new_wall - old_wall AS delta FROM ({_STAGE_CHANGES}) s) d WHERE abs(delta) >= 0.1
) r WHERE rank <= 5""",
    ("run_stages", "run_pairs"),
)
def top_stage_deltas(spark, sf_dir):
    stages = views.run_stages(spark, sf_dir)
    changes = runs.stage_changes(stages, views.run_pairs(stages))
    return runs.top_stage_deltas(changes)


# Ratings and messages as CASE expressions over run totals, by rule name.
_MB = "(last_file_kb / 1024.0)"


def _said(value: str, digits: int, unit: str, note: str) -> str:
    """Java rounds halves up where printf looks at the binary value."""
    return f"printf('%.{digits}f', round({value}, {digits})) || '{unit} — {note}'"


def _band(value: str, digits: int, unit: str, undefined: str, excuse: str, steps) -> tuple:
    def cases(shown) -> str:
        return " ".join(
            f"WHEN {value} < {limit} THEN {shown(rating, note)}"
            if limit is not None
            else f"ELSE {shown(rating, note)}"
            for limit, rating, note in steps
        )

    rating = cases(lambda rating, note: f"'{rating}'")
    message = cases(lambda rating, note: _said(value, digits, unit, note))
    return (
        f"CASE WHEN {undefined} THEN 'PASS' {rating} END",
        f"CASE WHEN {undefined} THEN '{runs.EXCUSES[excuse]}' {message} END",
    )


def _collections() -> tuple:
    few, some = "GREATEST(5, count // 5000)", "GREATEST(20, count // 1000)"
    says = {k: f"printf('{v}', CAST(gc_g2 AS BIGINT))" for k, v in runs.GC2_NOTES.items() if "%" in v}
    return (
        f"CASE WHEN count <= 0 OR gc_g2 <= {few} THEN 'PASS' "
        f"WHEN gc_g2 <= {some} THEN 'WARN' ELSE 'FAIL' END",
        f"CASE WHEN count <= 0 THEN '{runs.GC2_NOTES['empty']}' "
        f"WHEN gc_g2 = 0 THEN '{runs.GC2_NOTES['zero']}' WHEN gc_g2 <= {few} THEN {says['few']} "
        f"WHEN gc_g2 <= {some} THEN {says['some']} ELSE {says['many']} END",
    )


_RATINGS = {
    "rule_compression": (
        "MemΔ vs file size",
        *_band(f"(mem_mb / {_MB})", 1, "×", f"mem_mb <= 0 OR {_MB} <= 0", "file", runs.COMPRESSION),
    ),
    "rule_cpu_wall": (
        "CPU/Wall ratio",
        *_band("(cpu_ms / wall_ms)", 2, "", "wall_ms <= 0", "wall", runs.CPU_WALL),
    ),
    "rule_gc2": ("GC gen-2 count", *_collections()),
    "rule_write_share": (
        "Parquet write dominance",
        *_band("(write_ms / wall_ms * 100)", 0, "%", "wall_ms <= 0", "wall", runs.WRITE_SHARE),
    ),
    "rule_peak_ratio": (
        "Peak vs total allocated",
        *_band("(peak_mb / mem_mb)", 1, "×", "mem_mb <= 0", "allocation", runs.PEAK_RATIO),
    ),
    "rule_validation_share": (
        "Validation overhead",
        *_band(
            "(validation_ms / wall_ms * 100)",
            1,
            "%",
            "wall_ms <= 0 OR validation_ms <= 0",
            "validation",
            runs.VALIDATION_SHARE,
        ),
    ),
    "rule_conversion_share": (
        "Column conversion cost",
        *_band(
            "(conversion_ms / wall_ms * 100)",
            1,
            "%",
            "wall_ms <= 0 OR conversion_ms <= 0",
            "conversion",
            runs.CONVERSION_SHARE,
        ),
    ),
}


def _outcomes(names) -> str:
    return " UNION ALL ".join(
        f"SELECT run_id, '{_RATINGS[n][0]}' AS rule, {_RATINGS[n][1]} AS rating, "
        f"{_RATINGS[n][2]} AS message FROM run_totals"
        for n in names
    )


_DEFAULT = [f.__name__ for f in runs.DEFAULT_RULES]


@query("rule_outcomes", _outcomes(_RATINGS), ("run_totals",))
def rule_outcomes(spark, sf_dir):
    return runs.rule_outcomes(_summary(spark, sf_dir), runs.VERBOSE_RULES)


def _one_rule(name: str) -> None:
    rule = getattr(runs, name)

    @query(name, _outcomes([name]), ("run_totals",))
    def run(spark, sf_dir):
        return runs.rule_outcomes(_summary(spark, sf_dir), [rule])


for _rule in _RATINGS:
    _one_rule(_rule)

_SEVERITY = "CASE {} WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END"
_RULE_CHANGES = f"""
SELECT *, CASE WHEN {_SEVERITY.format('new_rating')} > {_SEVERITY.format('old_rating')}
  THEN new_rating ELSE 'PASS' END AS verdict
FROM (
  SELECT p.pair_id, a.rule, a.rating AS old_rating, b.rating AS new_rating FROM run_pairs p
  JOIN outcomes a ON a.run_id = p.run_a JOIN outcomes b ON b.run_id = p.run_b AND b.rule = a.rule
) c WHERE old_rating <> new_rating"""


@query(
    "rule_changes",
    f"WITH outcomes AS MATERIALIZED ({_outcomes(_DEFAULT)}) {_RULE_CHANGES}",
    ("run_totals", "run_pairs"),
)
def rule_changes(spark, sf_dir):
    stages = views.run_stages(spark, sf_dir)
    return runs.run_compare(stages, views.run_pairs(stages))["rule_changes"]


@query(
    "final_verdict",
    f"""
WITH outcomes AS MATERIALIZED ({_outcomes(_DEFAULT)}),
verdicts AS (SELECT pair_id, verdict FROM ({_CHANGES}) m
  UNION ALL SELECT pair_id, verdict FROM ({_RULE_CHANGES}) r)
SELECT pair_id, CASE MAX({_SEVERITY.format('verdict')}) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN'
  ELSE 'PASS' END AS final_verdict
FROM verdicts GROUP BY pair_id""",
    ("run_totals", "run_pairs"),
)
def final_verdict(spark, sf_dir):
    stages = views.run_stages(spark, sf_dir)
    return runs.run_compare(stages, views.run_pairs(stages))["final_verdict"]


@query(
    "net_cpu_regime",
    """
SELECT run_id, net_wait_ms, net_cpu_ratio, CASE WHEN net_cpu_ratio < 0.5 THEN 'CPU-bound'
  WHEN net_cpu_ratio > 1.5 THEN 'network-bound' ELSE 'balanced' END AS regime
FROM (SELECT run_id, wall_ms - cpu_ms AS net_wait_ms,
  CASE WHEN cpu_ms > 0 THEN (wall_ms - cpu_ms) / cpu_ms ELSE 0 END AS net_cpu_ratio
  FROM run_totals) t""",
    ("run_totals",),
)
def net_cpu_regime(spark, sf_dir):
    return runs.net_cpu_regime(_summary(spark, sf_dir))


_BANDS = [
    ("wall_us", "wall_ms / count * 1000", 5, 10),
    ("cpu_us", "cpu_ms / count * 1000", 4, 8),
    ("memory_bytes", "mem_mb / count * 1024", 850, 1500),
    ("peak_ratio", "CASE WHEN mem_mb > 0 THEN peak_mb / mem_mb ELSE 0 END", 2.5, 4),
    ("file_bytes", "last_file_kb * 1024 / count", 50, 80),
    ("gc_g2", "CAST(gc_g2 AS DOUBLE)", 5, 20),
]


@query(
    "per_record_bands",
    " UNION ALL ".join(
        f"SELECT run_id, '{name}' AS measure, value, CASE WHEN value < {warn} THEN 'PASS' "
        f"WHEN value < {fail} THEN 'WARN' ELSE 'FAIL' END AS rating "
        f"FROM (SELECT run_id, {value} AS value FROM run_totals WHERE count > 0) t"
        for name, value, warn, fail in _BANDS
    ),
    ("run_totals",),
)
def per_record_bands(spark, sf_dir):
    return runs.per_record_bands(_summary(spark, sf_dir))


# --- the run log -----------------------------------------------------------------

_STAMP = "strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(run_id), '%Y-%m-%dT%H:%M:%S')"


def _written_log(spark: SparkSession, sf_dir: str) -> str:
    path = shared_dir(spark, "run-log")
    runlog.append_runs(views.run_log(spark, sf_dir), path)
    return path


@query(
    "run_log_append",
    f"SELECT {_STAMP} AS run_id, runner, count, stage_no AS line, stage, wall_ms, cpu_ms, "
    "mem_delta_mb, peak_mb, file_kb FROM run_stages",
    ("run_stages",),
)
def run_log_append(spark, sf_dir):
    """Stages read back from the log; ``line`` is restored from the stage's name."""
    log = runlog.scan_runs(spark, _written_log(spark, sf_dir))
    stages = runlog.stage_rows(log)
    names = F.array(*[F.lit(s) for s in views.STAGES])
    line = F.array_position(names, F.col("stage")) - 1
    return stages.select(
        "run_id",
        "runner",
        "count",
        line.alias("line"),
        "stage",
        "wall_ms",
        "cpu_ms",
        "mem_delta_mb",
        "peak_mb",
        "file_kb",
    )


@query(
    "run_log_scan",
    f"""
SELECT timestamp, runner, count, stages FROM (
  SELECT {_STAMP} AS timestamp, runner, count, COUNT(*) AS stages, run_id FROM run_stages
  WHERE runner = 'r3' GROUP BY run_id, runner, count ORDER BY run_id DESC LIMIT 25) t""",
    ("run_stages",),
)
def run_log_scan(spark, sf_dir):
    log = runlog.scan_runs(spark, _written_log(spark, sf_dir), runner="r3", last=25)
    stages = F.size("stage_breakdown").cast("long").alias("stages")
    return log.select("timestamp", "runner", "count", stages)


@query(
    "list_runs",
    f"""
SELECT {_STAMP} AS date, runner, count, SUM(wall_ms) AS wall_ms, SUM(cpu_ms) AS cpu_ms,
  substr(concat('sha', lpad(CAST(run_id AS VARCHAR), 7, '0')), 1, 7) AS git_sha
FROM run_stages GROUP BY run_id, runner, count""",
    ("run_stages",),
)
def list_runs(spark, sf_dir):
    return runs.list_runs(runlog.scan_runs(spark, _written_log(spark, sf_dir)))


def _records(spark: SparkSession, sf_dir: str, rules=runs.VERBOSE_RULES) -> DataFrame:
    """Log records of all runs, written to a log and read back, with their run's number."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    zero = F.lit(0)
    seconds = F.make_dt_interval(zero, zero, zero, F.col("run_id").cast("decimal(18,6)"))
    sha = F.concat(F.lit("sha"), F.lpad(F.col("run_id").cast("string"), 7, "0"))
    path = shared_dir(spark, "records")
    records = logged.run_records(
        views.run_stages(spark, sf_dir), iso_text(start + seconds), rules, git_sha=sha
    )
    runlog.append_runs(records, path)
    number = F.substring("git_sha", 4, 20).cast("long")
    return runlog.scan_runs(spark, path).withColumn("run_id", number)


@query(
    "run_records",
    f"""
SELECT run_id, {_STAMP} AS timestamp, runner, count, 7 AS rules, metric,
  round(CAST(median AS DOUBLE), 2) AS median
FROM ({" UNION ALL ".join(
        f"SELECT run_id, runner, count, '{m}' AS metric, CAST({m} AS DOUBLE) AS median FROM run_totals"
        for m in logged.LOGGED)}) t""",
    ("run_totals",),
)
def run_records(spark, sf_dir):
    log = _records(spark, sf_dir)
    return log.select(
        "run_id", "timestamp", "runner", "count", F.size("rules").alias("rules"),
        F.explode("summary").alias("metric", "m"),
    ).select("run_id", "timestamp", "runner", "count", "rules", "metric", "m.median")


@query("logged_compare", _CHANGES, ("run_totals", "run_pairs"))
def logged_compare(spark, sf_dir):
    pairs = views.run_pairs(views.run_stages(spark, sf_dir))
    found = logged.logged_compare(_records(spark, sf_dir), pairs)["summary"]
    return found.select("pair_id", "metric", "old", "new", "pct", "verdict")


@query(
    "logged_rule_changes",
    f"WITH outcomes AS MATERIALIZED ({_outcomes(_RATINGS)}) {_RULE_CHANGES}",
    ("run_totals", "run_pairs"),
)
def logged_rule_changes(spark, sf_dir):
    pairs = views.run_pairs(views.run_stages(spark, sf_dir))
    return logged.logged_compare(_records(spark, sf_dir), pairs)["rule_changes"]


@query(
    "logged_trend",
    f"""
SELECT runner, index, {_STAMP} AS timestamp, 'sha' || lpad(CAST(run_id AS VARCHAR), 7, '0') AS git_sha,
  value, pct, COALESCE(abs(pct) > 0.05, FALSE) AS flagged
FROM ({_TREND.format('run_totals')}) t""",
    ("run_totals",),
)
def logged_trend(spark, sf_dir):
    return logged.logged_trend(_records(spark, sf_dir, runs.DEFAULT_RULES), "cpu_ms")


@query(
    "timeframe_steps",
    """
SELECT user_id, timeframe, strftime(CASE timeframe WHEN '1m' THEN last + INTERVAL 1 MINUTE
    WHEN '4h' THEN last + INTERVAL 4 HOUR WHEN '1w' THEN last + INTERVAL 7 DAY
    WHEN '1M' THEN last + INTERVAL 1 MONTH ELSE last + INTERVAL 3 MONTH END, '%Y-%m-%dT%H:%M:%S')
  AS next
FROM (SELECT user_id, ['1m', '4h', '1w', '1M', '3M'][1 + user_id % 5] AS timeframe,
  CAST(date_trunc('second', MAX(ts)) AS TIMESTAMP) AS last FROM events GROUP BY user_id) t""",
)
def timeframe_steps(spark, sf_dir):
    names = F.array(*[F.lit(t) for t in ("1m", "4h", "1w", "1M", "3M")])
    last = (
        views.table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.date_trunc("second", F.max("ts")).cast("timestamp_ntz").alias("last"))
        .withColumn("timeframe", F.try_element_at(names, (F.col("user_id") % 5 + 1).cast("int")))
    )
    steps = last.join(F.broadcast(timeframe_lengths(spark)), "timeframe")
    following = step_after(F.col("last"), F.col("seconds"), F.col("months"))
    return steps.select("user_id", "timeframe", iso_text(following).alias("next"))
