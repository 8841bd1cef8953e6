"""Run log records: building them from stages, and comparing what was logged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import previous
from tickloom.operators.runs import (
    DEFAULT_RULES,
    METRICS,
    TREND_FLAG,
    _sides,
    final_verdict,
    old_and_new,
    pct_change,
    regression_verdict,
    rule_changes,
    run_summary,
    stage_changes,
    top_stage_deltas,
)
from tickloom.schemas import METRIC_STRUCT, RULE_STRUCT, RUN_LOG, STAGE_STRUCT

LOGGED = (*METRICS, "cpu_wall_ratio")


def run_records(
    stages: DataFrame,
    stamp: Column,
    rules: Sequence = DEFAULT_RULES,
    iterations: Column | None = None,
    bounds: DataFrame | None = None,
    resolution: str = "s",
    git_sha: Column | None = None,
    git_ref: str = "main",
) -> DataFrame:
    """One log record per run: totals, stages in order, and the outcome of each rule.

    ``bounds`` (run_id, metric, ci_lo, ci_hi) adds confidence bounds to a metric. ``stamp``,
    ``iterations`` and ``git_sha`` are expressions over the run summary. A run has a handful
    of stages, which end in one record.
    """
    listed = stages.groupBy("run_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "stage_no",
                    F.col("stage").alias("name"),
                    *[
                        (F.col(f.name) if f.name in stages.columns else F.lit(0))
                        .cast(f.dataType)
                        .alias(f.name)
                        for f in STAGE_STRUCT.fields[1:]
                    ],
                )
            )
        ).alias("stages")
    )
    per_run = run_summary(stages).join(listed, "run_id")
    if bounds is not None:
        known = bounds.groupBy("run_id").agg(
            F.map_from_entries(
                F.collect_list(F.struct("metric", F.struct("ci_lo", "ci_hi")))
            ).alias("bounds")
        )
        per_run = per_run.join(known, "run_id", "left")

    def entry(metric: str) -> Column:
        nothing = F.lit(None).cast("double")
        limits = [nothing, nothing]
        if bounds is not None:
            pair = F.try_element_at("bounds", F.lit(metric))
            limits = [F.round(pair[side], 2) for side in ("ci_lo", "ci_hi")]
        median = F.round(F.col(metric).cast("double"), 2)
        return F.struct(median, *limits).cast(METRIC_STRUCT)

    summary = F.create_map(*[x for m in LOGGED for x in (F.lit(m), entry(m))])
    outcomes = F.array(*[rule().cast(RULE_STRUCT) for rule in rules])
    columns = {
        "timestamp": stamp,
        "iterations": F.lit(1) if iterations is None else iterations,
        "ts_resolution": F.lit(resolution),
        "summary": summary,
        "stage_breakdown": F.transform("stages", lambda s: s.dropFields("stage_no")),
        "rules": outcomes,
        "git_sha": F.lit("") if git_sha is None else git_sha,
        "git_ref": F.lit(git_ref),
    }
    return per_run.select(
        "run_id",
        *[columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in RUN_LOG],
    )


def logged_value(metric: str) -> Column:
    """The median that a record has for a metric, 0 without one."""
    return F.coalesce(F.try_element_at("summary", F.lit(metric))["median"], F.lit(0.0))


def logged_compare(log: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """All tables of a comparison of logged runs, from what their records say.

    ``log`` has a distinct ``run_id``; ``pairs`` has pair_id, run_a and run_b.
    """
    sides = _sides(pairs)
    values = log.select("run_id", *[logged_value(m).alias(m) for m in METRICS])
    metrics = regression_verdict(old_and_new(values.join(sides, "run_id")))
    outcomes = log.select("run_id", F.explode("rules").alias("r")).select(
        "run_id", F.col("r.name").alias("rule"), "r.rating"
    )
    changed = rule_changes(outcomes, pairs)
    stages = log.select("run_id", F.posexplode("stage_breakdown").alias("stage_no", "s")).select(
        "run_id", "stage_no", F.col("s.name").alias("stage"), "s.wall_ms"
    )
    return {
        "summary": metrics,
        "rule_changes": changed,
        "stage_deltas": top_stage_deltas(stage_changes(stages, pairs)),
        "final_verdict": final_verdict(metrics, changed),
    }


def logged_trend(log: DataFrame, metric: str, keys: Sequence[str] = ("runner",)) -> DataFrame:
    """A logged metric in the order of time: index, timestamp, git_sha, value, pct, flagged."""
    entries = log.select(
        *keys,
        "timestamp",
        "git_sha",
        logged_value(metric).alias("value"),
        F.unix_micros(F.try_to_timestamp("timestamp")).alias("_at"),
    )
    found = previous(entries, keys, "_at", "value", "_before", "_index")
    change = pct_change(F.col("_before"), F.col("value"))
    return found.select(
        *keys,
        (F.col("_index") - 1).alias("index"),
        "timestamp",
        "git_sha",
        "value",
        change.alias("pct"),
        F.coalesce(F.abs(change) > TREND_FLAG, F.lit(False)).alias("flagged"),
    )
