import pytest
from pyspark.sql import functions as F

from helpers import as_set
from tickloom.operators import runs
from tickloom.sources import runlog

COLUMNS = (
    "run_id long, runner string, count long, stage_no long, stage string, wall_ms double, "
    "cpu_ms double, mem_delta_mb double, peak_mb double, gc_g2 long, file_kb double, "
    "pipeline_end long"
)


def stage(run, no, name, wall=10.0, cpu=9.0, mem=1.0, peak=1.2, g2=0, file=None, end=2, n=1000):
    measured = [float(x) for x in (wall, cpu, mem, peak)]
    return (run, "candle", n, no, name, *measured, g2, file, end)


def table(spark, *rows):
    return spark.createDataFrame(rows, COLUMNS)


def rating(spark, rule, **values):
    known = {
        "run_id": 1, "count": 1000, "wall_ms": 100.0, "cpu_ms": 90.0, "mem_mb": 10.0,
        "peak_mb": 12.0, "file_kb": 2048.0, "last_file_kb": 2048.0, "gc_g2": 0, "write_ms": 10.0,
        "validation_ms": 1.0, "conversion_ms": 1.0, **values,
    }
    df = spark.createDataFrame([known])
    row = runs.rule_outcomes(df, [rule]).first()
    return row["rating"], row["message"]


def test_summary(spark):
    df = table(
        spark,
        stage(1, 0, "Candle creation", 10, 9, 2, 5),
        stage(1, 1, "Decimal cast", 20, 18, -1, 7),
        stage(1, 2, "Parquet write", 30, 20, 3, 6, 2, 50.0),
        stage(1, 3, "Validation", 5, 5, 9, 40, 1, 60.0),
    )
    row = runs.run_summary(df).first().asDict()
    assert row == {
        "run_id": 1, "runner": "candle", "count": 1000, "wall_ms": 60.0, "cpu_ms": 47.0,
        "mem_mb": 5.0, "peak_mb": 40.0, "file_kb": 60.0, "gc_g2": 2, "write_ms": 30.0,
        "last_file_kb": 60.0, "validation_ms": 25.0, "conversion_ms": 20.0,
        "cpu_wall_ratio": 47.0 / 60.0,
    }


@pytest.mark.parametrize(
    "rule,values,expected",
    [
        (runs.rule_compression, {"mem_mb": 8.0}, "PASS"),
        (runs.rule_compression, {"mem_mb": 30.0}, "WARN"),
        (runs.rule_compression, {"mem_mb": 60.0}, "FAIL"),
        (runs.rule_compression, {"last_file_kb": 0.0}, "PASS"),
        (runs.rule_cpu_wall, {"cpu_ms": 80.0}, "PASS"),
        (runs.rule_cpu_wall, {"cpu_ms": 50.0}, "WARN"),
        (runs.rule_cpu_wall, {"cpu_ms": 49.0}, "FAIL"),
        (runs.rule_cpu_wall, {"wall_ms": 0.0}, "PASS"),
        (runs.rule_gc2, {"gc_g2": 5}, "PASS"),
        (runs.rule_gc2, {"gc_g2": 6}, "WARN"),
        (runs.rule_gc2, {"gc_g2": 21}, "FAIL"),
        (runs.rule_gc2, {"gc_g2": 21, "count": 50_000}, "WARN"),
        (runs.rule_gc2, {"gc_g2": 99, "count": 0}, "PASS"),
        (runs.rule_write_share, {"write_ms": 59.0}, "PASS"),
        (runs.rule_write_share, {"write_ms": 60.0}, "WARN"),
        (runs.rule_write_share, {"write_ms": 80.0}, "FAIL"),
        (runs.rule_peak_ratio, {"peak_mb": 24.0}, "PASS"),
        (runs.rule_peak_ratio, {"peak_mb": 25.0}, "WARN"),
        (runs.rule_peak_ratio, {"peak_mb": 40.0}, "FAIL"),
        (runs.rule_peak_ratio, {"mem_mb": 0.0}, "PASS"),
        (runs.rule_validation_share, {"validation_ms": 5.0}, "WARN"),
        (runs.rule_validation_share, {"validation_ms": 10.0}, "FAIL"),
        (runs.rule_conversion_share, {"conversion_ms": 19.0}, "PASS"),
        (runs.rule_conversion_share, {"conversion_ms": 34.0}, "WARN"),
        (runs.rule_conversion_share, {"conversion_ms": 35.0}, "FAIL"),
    ],
)
def test_rules(spark, rule, values, expected):
    assert rating(spark, rule, **values)[0] == expected


def test_messages(spark):
    assert rating(spark, runs.rule_cpu_wall)[1] == "0.90 — near 1.0, no I/O or lock contention."
    assert rating(spark, runs.rule_write_share)[1] == "10% — write is not the bottleneck."
    assert rating(spark, runs.rule_compression, mem_mb=0.0)[1] == (
        "No file written — nothing to compare."
    )
    assert rating(spark, runs.rule_gc2)[1] == (
        "Zero gen-2 collections — no long-lived garbage."
    )


def test_no_stages_pass_everything(spark):
    zero = dict.fromkeys(
        ("wall_ms", "cpu_ms", "mem_mb", "peak_mb", "last_file_kb", "write_ms", "validation_ms",
         "conversion_ms"), 0.0,
    )
    for rule in runs.VERBOSE_RULES:
        assert rating(spark, rule, **zero)[0] == "PASS"
    assert len(runs.DEFAULT_RULES) == 5 and len(runs.VERBOSE_RULES) == 7


def test_confidence_bounds(spark):
    values = [("three", 1.0), ("three", 2.0), ("three", 6.0), ("two", 1.0), ("two", 4.0), ("one", 3.0)]
    df = spark.createDataFrame(values, "runner string, wall_ms double")
    found = {r["runner"]: r for r in runs.run_ci(df, "wall_ms").collect()}
    assert tuple(found["one"])[1:] == (1, 3.0, 3.0, 3.0)
    assert tuple(found["two"])[1:] == (2, 2.5, 2.5, 2.5)
    margin = 4.303 * 7**0.5 / 3**0.5
    assert found["three"]["median"] == 2.0
    assert found["three"]["ci_lo"] == pytest.approx(3.0 - margin)
    assert found["three"]["ci_hi"] == pytest.approx(3.0 + margin)


def test_median_run_takes_the_first_of_equals(spark):
    df = spark.createDataFrame(
        [("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 14.0), ("a", 4, 16.0)],
        "runner string, run_id long, wall_ms double",
    )
    assert runs.median_run(df).first()["run_id"] == 3


def test_trend(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.0), ("a", 2, 10.0), ("a", 3, 10.4), ("a", 4, 5.2), ("b", 1, 1.0)],
        "runner string, run_no long, wall_ms double",
    )
    rows = runs.run_trend(df, "wall_ms", "run_no").where("runner = 'a'").orderBy("index").collect()
    assert [r["pct"] and round(r["pct"], 3) for r in rows] == [None, None, 0.04, -0.5]
    assert [r["flagged"] for r in rows] == [False, False, False, True]
    last = runs.run_trend(df, "wall_ms", "run_no", last=2).where("runner = 'a'")
    assert as_set(last, "run_no", "index") == {(3, 0), (4, 1)}
    assert last.where("index = 0").first()["pct"] is None


def test_compare(spark):
    df = table(
        spark,
        stage(1, 0, "read", 10, 10, 1, 1, 0),
        stage(1, 1, "gone", 5, 5, 1, 1, 0),
        stage(1, 2, "same", 5, 5, 1, 1, 0, 100.0),
        stage(2, 0, "read", 14, 10.6, 1, 1, 1),
        stage(2, 1, "new", 1, 5, 1, 1, 0),
        stage(2, 2, "same", 5.05, 5, 1, 1, 0, 160.0),
    )
    pairs = spark.createDataFrame([(7, 1, 2)], "pair_id long, run_a long, run_b long")
    found = runs.run_compare(df, pairs)
    verdicts = {r["metric"]: (r["verdict"], r["reason"]) for r in found["summary"].collect()}
    assert verdicts == {
        "cpu_ms": ("PASS", ""),
        "wall_ms": ("PASS", ""),
        "mem_mb": ("PASS", ""),
        "peak_mb": ("PASS", ""),
        "file_kb": ("FAIL", "regressed +60.0%"),
        "gc_g2": ("WARN", "GC gen-2 appeared: 0 → 1"),
    }
    deltas = found["stage_deltas"].orderBy("rank").select("stage", "delta", "pct_text").collect()
    assert [tuple(r) for r in deltas] == [
        ("gone", -5.0, "-100.0%"), ("read", 4.0, "+40.0%"), ("new", 1.0, "new"),
    ]
    assert found["final_verdict"].first()["final_verdict"] == "FAIL"


def test_regime_and_bands(spark):
    df = spark.createDataFrame(
        [(1, 100.0, 90.0, 1), (2, 100.0, 30.0, 1), (3, 100.0, 50.0, 1), (4, 5.0, 0.0, 1)],
        "run_id long, wall_ms double, cpu_ms double, x int",
    )
    assert as_set(runs.net_cpu_regime(df), "run_id", "regime") == {
        (1, "CPU-bound"), (2, "network-bound"), (3, "balanced"), (4, "CPU-bound"),
    }
    full = df.where("run_id = 1").withColumns(
        {
            "count": F.lit(10_000), "mem_mb": F.lit(10.0), "peak_mb": F.lit(30.0),
            "last_file_kb": F.lit(600.0), "gc_g2": F.lit(5),
        }
    )
    found = as_set(runs.per_record_bands(full), "measure", "rating")
    assert found == {
        ("wall_us", "FAIL"), ("cpu_us", "FAIL"), ("memory_bytes", "PASS"),
        ("peak_ratio", "WARN"), ("file_bytes", "WARN"), ("gc_g2", "WARN"),
    }
    assert runs.per_record_bands(full.withColumn("count", F.lit(0))).count() == 0


def test_cumulative(spark):
    df = table(
        spark, stage(1, 0, "a", 10.0), stage(1, 1, "b", 30.0), stage(1, 2, "c", 5.0, end=1),
    ).withColumn("pipeline_end", F.lit(1).cast("long"))
    rows = runs.stage_cumulative(df).orderBy("stage_no").collect()
    assert [(r["cum_wall"], r["wall_share"]) for r in rows] == [(10.0, 25.0), (40.0, 100.0), (45.0, 0.0)]


def test_run_log_round_trip(spark, sf_dir, tmp_path):
    from tickloom.plans import views

    path = str(tmp_path / "log")
    log = views.run_log(spark, sf_dir)
    runlog.append_runs(log.where("runner = 'r1'"), path)
    runlog.append_runs(log.where("runner = 'r2'"), path)
    read = runlog.scan_runs(spark, path)
    assert read.count() == log.where("runner in ('r1', 'r2')").count()
    last = runlog.scan_runs(spark, path, runner="r2", last=3)
    assert last.count() == 3 and as_set(last, "runner") == {("r2",)}
    assert runlog.stage_rows(read).count() == (
        views.run_stages(spark, sf_dir).where("runner in ('r1', 'r2')").count()
    )


def test_records_are_written_compressed(spark, sf_dir, tmp_path):
    from tickloom.plans import views

    log = views.run_log(spark, sf_dir)
    runlog.append_runs(log, str(tmp_path / "log"))
    log.write.json(str(tmp_path / "plain"))

    def size(name):
        return sum(p.stat().st_size for p in (tmp_path / name).glob("part-*"))

    assert size("log") < size("plain") / 4
    read = [runlog.scan_runs(spark, str(tmp_path / name)) for name in ("log", "plain")]
    assert read[0].count() == log.count()
    rows = [as_set(r, "git_sha", "timestamp", F.to_json("stage_breakdown")) for r in read]
    assert rows[0] == rows[1]


def test_parts_of_a_shuffle_stay_small(spark):
    from tickloom.session import LEAST_PARTITIONS, PARTITIONS, configure

    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "12")
    assert int(configure(session).conf.get(PARTITIONS)) == LEAST_PARTITIONS
    session.conf.set("spark.sql.shuffle.partitions", "3000")
    assert configure(session).conf.get(PARTITIONS) == "3000"
    # 48 MB that compress little came to one task with the session's one part.
    session.conf.set("spark.sql.shuffle.partitions", "1")
    configure(session)
    rows = session.range(0, 48_000, 1, 8).select("id", F.randstr(1000, 7).alias("text"))
    assert rows.groupBy("id").agg(F.max("text")).rdd.getNumPartitions() > 2


def test_metrics_become_rows_after_the_aggregate(spark):
    values = {m: float(i) for i, m in enumerate(runs.METRICS)}
    sides = spark.createDataFrame(
        [{"pair_id": 1, "newer": False, **values}, {"pair_id": 1, "newer": False, **values, "cpu_ms": 5.0},
         {"pair_id": 2, "newer": True, **{m: v + 1 for m, v in values.items()}},
         {"pair_id": None, "newer": True, **dict.fromkeys(values), "gc_g2": 3.0}]
    )
    found = runs.old_and_new(sides)
    want = {(1, m, v, 0.0) for m, v in values.items() if m != "cpu_ms"} | {(1, "cpu_ms", 5.0, 0.0)}
    want |= {(2, m, 0.0, v + 1) for m, v in values.items()}
    want |= {(None, m, 0.0, 3.0 if m == "gc_g2" else 0.0) for m in values}
    assert as_set(found, "pair_id", "metric", "old", "new") == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.index("Aggregate")
