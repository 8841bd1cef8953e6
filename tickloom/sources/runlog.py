"""The run log: one JSON object per line and run, in compressed files (uncompressed ones are read too)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.schemas import RUN_LOG


def append_runs(runs: DataFrame, path: str) -> None:
    names = [f.name for f in RUN_LOG]
    runs.select(*names).write.mode("append").json(path, compression="gzip")


def scan_runs(
    spark: SparkSession, path: str, runner: str | None = None, last: int | None = None
) -> DataFrame:
    """All runs, or those of one runner, or the last n of them by time."""
    runs = spark.read.schema(RUN_LOG).json(path)
    if runner is not None:
        runs = runs.where(F.col("runner") == runner)
    if last is not None:
        runs = runs.orderBy(F.desc("timestamp"), F.desc("git_sha")).limit(last)
    return runs


def stage_rows(runs: DataFrame, run_id: str = "timestamp") -> DataFrame:
    """Flat ``(run_id, runner, count, stage_no, stage, measurements...)`` rows."""
    return runs.select(
        F.col(run_id).alias("run_id"),
        "runner",
        "count",
        F.posexplode("stage_breakdown").alias("stage_no", "s"),
    ).select(
        "run_id",
        "runner",
        "count",
        F.col("stage_no").cast("long").alias("stage_no"),
        F.col("s.name").alias("stage"),
        *[
            F.col(f"s.{m}").alias(m)
            for m in (
                "wall_ms",
                "cpu_ms",
                "mem_delta_mb",
                "peak_mb",
                "gc_g0",
                "gc_g1",
                "gc_g2",
                "file_kb",
            )
        ],
    )
