"""Merging a batch into stored rows by natural key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.cast import schema_align

UPSERT, CHANGES = "upsert", "changes"
STRATEGIES = (UPSERT, CHANGES)
INSERT, UPDATE, UNCHANGED, KEEP = "insert", "update", "unchanged", "keep"


def upsert_merge(
    existing: DataFrame,
    incoming: DataFrame,
    key: Sequence[str],
    incoming_unique: bool = False,
) -> DataFrame:
    """Stored rows whose key is not incoming, and all incoming rows.

    The incoming side of the anti join is keys only. Where the caller does not know
    that they are unique (the validation gate guarantees it), they are made distinct
    first, with a partial aggregate before the shuffle. Adaptive execution broadcasts
    the keys or splits a hot one.
    """
    aligned = schema_align(existing, incoming.schema)
    keys = incoming.select(*key)
    if not incoming_unique:
        keys = keys.distinct()
    kept = aligned.join(keys, list(key), "left_anti").select(*incoming.columns)
    return kept.unionByName(incoming)


def classify_changes(
    existing: DataFrame, incoming: DataFrame, key: Sequence[str]
) -> DataFrame:
    """Every key of either side with its ``action`` and its row after the merge.

    Both sides are stacked and grouped by key: one shuffle, a partial aggregate
    before it, null keys match, and a key never meets another row in a join. A key
    that occurs twice on one side fails the job, since "the" row of that key would
    be undefined; the duplicate rule of the gate reports such batches beforehand.
    """
    data = [c for c in incoming.columns if c not in key]

    def side(df: DataFrame, stored: bool) -> DataFrame:
        row = F.struct(*data)
        nothing = F.lit(None).cast(_struct_type(incoming, data))
        return df.select(
            *key,
            (row if stored else nothing).alias("old"),
            (nothing if stored else row).alias("new"),
            F.lit(stored).alias("stored"),
        )

    stacked = side(schema_align(existing, incoming.schema), True).unionByName(
        side(incoming, False)
    )
    per_key = stacked.groupBy(*key).agg(
        F.first("old", ignorenulls=True).alias("old"),
        F.first("new", ignorenulls=True).alias("new"),
        F.count_if("stored").alias("n_old"),
        F.count_if(~F.col("stored")).alias("n_new"),
    )
    repeated = (F.col("n_old") > 1) | (F.col("n_new") > 1)
    refusal = F.raise_error(F.lit("a merge input holds a key more than once"))
    # The guard is part of both results, as a caller may drop either.
    action = (
        F.when(repeated, refusal.cast("string"))
        .when(F.col("n_old") == 0, INSERT)
        .when(F.col("n_new") == 0, KEEP)
        .when(F.col("old").eqNullSafe(F.col("new")), UNCHANGED)
        .otherwise(UPDATE)
    )
    row = (
        F.when(repeated, refusal.cast(_struct_type(incoming, data)))
        .when(F.col("n_new") == 0, F.col("old"))
        .otherwise(F.col("new"))
    )
    rows = per_key.select(*key, action.alias("action"), row.alias("row"))
    return rows.select("action", *[c if c in key else f"row.{c}" for c in incoming.columns])


def _struct_type(df: DataFrame, fields: Sequence[str]) -> str:
    return df.select(F.struct(*fields).alias("s")).schema["s"].dataType.simpleString()


def change_merge(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored table after the merge; rows sent again unchanged stay as stored."""
    return classify_changes(existing, incoming, key).drop("action")


def merge_change_log(
    existing: DataFrame, incoming: DataFrame, key: Sequence[str]
) -> DataFrame:
    """How many rows a merge would insert, update, leave unchanged or keep."""
    return (
        classify_changes(existing, incoming, key)
        .groupBy("action")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def merge(
    existing: DataFrame,
    incoming: DataFrame,
    key: Sequence[str],
    strategy: str = UPSERT,
    incoming_unique: bool = False,
) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    if strategy == CHANGES:
        return change_merge(existing, incoming, key)
    return upsert_merge(existing, incoming, key, incoming_unique)
