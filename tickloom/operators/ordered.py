"""Row numbers, running sums and previous values within keys of any size.

A window over a key runs in one task, which fails when the key holds a third of
a large table. Here keys with more than ``SLICE_ROWS`` rows are cut into slices along the
order column, at quantiles of the key's own values: one pass counts the rows per key, one more
sketches the quantiles of the large keys, which are written, so that every use cuts alike.
So slices are even however the values lie. The heavy window runs per ``(key, slice)``;
only one row per key and slice enters the second window that carries values across slices.
Without a large key a plain window does it. The order column must be numeric and distinct
within a key; nulls come first and NaN last.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import shared_dir
from tickloom.sources.staging import stage, staging

# Rows of a slice, and the most slices of a key.
SLICE_ROWS = 1 << 20
MOST_SLICES = 1 << 12

_SLICE, _CUTS = "_slice", "_cuts"


def quantile_cuts(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame | None:
    """Values that cut the large keys into even slices: keys and an ascending list; or None.

    There are no more large keys than ``SLICE_ROWS`` goes into the number of rows.
    """
    spark = df.sparkSession
    with staging(spark) as put:
        counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        large = put(counted.where(F.col("_rows") > SLICE_ROWS), "large-keys")
        most = large.agg(F.max("_rows")).first()[0]
        if most is None:
            return None
        slices = min(MOST_SLICES, math.ceil(most / SLICE_ROWS))
        shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
        rows = _same(df.select(*keys, order), large.drop("_rows"), keys, "left_semi")
        cuts = F.percentile_approx(order, shares, F.lit(10 * slices))
        found = rows.groupBy(*keys).agg(F.sort_array(F.array_distinct(cuts)).alias(_CUTS))
        return stage(found, shared_dir(spark, "cuts"))


def slice_number(cuts: Column, value: Column) -> Column:
    """How many cuts are not above a value; 0 without cuts. Looks at blocks of cuts first."""
    block = max(2, math.isqrt(MOST_SLICES))

    def passed(some: Column) -> Column:
        return F.size(F.filter(some, lambda cut: cut <= value))

    blocks = F.ceil(F.size(cuts) / block).cast("int")
    # The first cut of each block; those not above the value, but the last, are passed whole.
    heads = F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.get(cuts, i * block))
    whole = F.greatest(passed(heads) - 1, F.lit(0)) * block
    number = whole + passed(F.slice(cuts, whole + 1, block))
    return F.when(F.size(cuts) > 0, number).otherwise(0).cast("long")


def divide(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame | None:
    """The rows with the number of their slice; None if no key needs more than one."""
    cuts = quantile_cuts(df, keys, order)
    if cuts is None:
        return None
    joined = _same(df, cuts, keys, "left")
    return joined.withColumn(_SLICE, slice_number(F.col(_CUTS), F.col(order))).drop(_CUTS)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, in which nulls are equal; the right keys go."""
    named = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = part if condition is None else condition & part
    return left.join(named, condition, how).drop(*[f"_r_{k}" for k in keys])


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str
) -> DataFrame:
    """Sum over the rows of the key up to and including this one."""
    sliced = divide(df, keys, order)
    if sliced is None:
        upto = Window.partitionBy(*keys).orderBy(order)
        upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(name, F.sum(value).over(upto))
    totals = sliced.groupBy(*keys, _SLICE).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, _SLICE, F.sum("_total").over(before).alias("_before"))
    local = (
        Window.partitionBy(*keys, _SLICE)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    here = sliced.withColumn("_local", F.sum(value).over(local))
    joined = _same(here, carried, [*keys, _SLICE], "left")
    here, earlier = F.col("_local"), F.col("_before")
    done = joined.withColumn(name, F.coalesce(here + earlier, here, earlier))
    return done.drop(_SLICE, "_local", "_before")


def position(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """1-based position of the row within its key, as long."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), name)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    name: str,
    position_name: str | None = None,
) -> DataFrame:
    """``value`` of the row before this one in its key; null for the first.

    With ``position_name`` also the 1-based position, at no further shuffle.
    """
    sliced = divide(df, keys, order)
    if sliced is None:
        by_order = Window.partitionBy(*keys).orderBy(order)
        done = df.withColumn(name, F.lag(value).over(by_order))
        if position_name:
            done = done.withColumn(position_name, F.row_number().over(by_order).cast("long"))
        return done
    last = sliced.groupBy(*keys, _SLICE).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.col(order)).alias("_last"),
        F.count(F.lit(1)).alias("_rows"),
    )
    by_slice = Window.partitionBy(*keys).orderBy(_SLICE)
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(
        *keys,
        _SLICE,
        F.lag("_last").over(by_slice).alias("_carried"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
    )
    local = Window.partitionBy(*keys, _SLICE).orderBy(order)
    columns = {"_prev": F.lag(F.struct(F.col(value).alias("v"))).over(local)}
    if position_name:
        columns["_at"] = F.row_number().over(local).cast("long")
    joined = _same(sliced.withColumns(columns), carried, [*keys, _SLICE], "left")
    done = joined.withColumn(name, F.coalesce(F.col("_prev"), F.col("_carried"))["v"])
    if position_name:
        done = done.withColumn(position_name, F.col("_at") + F.col("_offset"))
    return done.drop("_prev", "_carried", "_offset", "_at", _SLICE)


__all__ = ["divide", "position", "previous", "quantile_cuts", "running_sum", "slice_number"]
