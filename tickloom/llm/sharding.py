"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every record scores each shard with a hash of its key and the shard's number, scaled by
the shard's weight, and goes to the best one. A shard's score does not depend on the
others, so an added shard takes records only into itself. MD5 is used as any other
system can repeat it.

A null key counts as the text "null"; null text is empty. Records of equal key share a
shard; equal rows are interchangeable. Slots number the records of a shard from 0, in
the order of a hash of key, checksum and size; of equal scores the lower shard wins. Texts of any
length are read whole. An empty table gives an empty table. Input columns are chosen by name,
others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.support import whole, written

# 13 hex digits are 52 bits: exact in a double.
HEX, UNIT = 13, float(1 << 52)


def unit_hash(key: Column) -> Column:
    """A number in (0, 1) fixed by the text of a key."""
    digits = F.substring(F.md5(key.cast("binary")), 1, HEX)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / UNIT


def score(key: Column, shard: Column, weight: Column) -> Column:
    """Larger is better; each shard wins in proportion to its weight."""
    chance = unit_hash(F.concat(key, F.lit(":"), shard.cast("string")))
    return F.struct((-weight / F.log(chance)).alias("score"), (-shard).alias("shard"))


def best(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """The score of the best of some shards, given as (number, weight)."""
    table = F.array(
        *[F.struct(F.lit(n).alias("n"), F.lit(float(w)).alias("weight")) for n, w in shards]
    )
    return F.array_max(F.transform(table, lambda s: score(key, s.n, s.weight)))


def place(
    rows: DataFrame,
    key: Column,
    shards: Sequence[tuple[int, float]],
    added: tuple[int, float] | None = None,
) -> DataFrame:
    """The rows with their shard, and grown_shard: where they go once a shard is added."""
    found = rows.withColumn("_best", best(key, shards))
    if added:
        more = score(key, F.lit(added[0]), F.lit(float(added[1])))
        found = found.withColumn("_more", F.greatest("_best", more))
    else:
        found = found.withColumn("_more", F.col("_best"))
    return (
        found.withColumn("shard", -F.col("_best.shard"))
        .withColumn("grown_shard", -F.col("_more.shard"))
        .drop("_best", "_more")
    )


def slots(placed: DataFrame, order: Sequence[str]) -> DataFrame:
    """Gapless numbers from 0 per shard, without bringing a shard to one task.

    A hash of the order columns cuts each shard into ranges; ranges are counted, then
    rows are numbered inside their range. The result does not depend on how many ranges
    there are. ``placed`` is read twice and should be a written table.
    """
    ranges = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order])
    cut = placed.withColumn("_hash", unit_hash(text)).withColumn(
        "_range", F.floor(F.col("_hash") * ranges).cast("int")
    )
    counted = cut.groupBy("shard", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counted.select(
        "shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("shard", "_range").orderBy("_hash", *order)
    return (
        cut.join(starts, ["shard", "_range"])
        .withColumn("slot", F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_hash", "_range", "_start")
    )


def shard_table(
    docs: DataFrame,
    shards: Sequence[tuple[int, float]],
    added: tuple[int, float],
    row_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Where each document goes: doc_id, size, text_crc32, shard, grown_shard, slot."""
    content = whole(text)
    key = F.coalesce(F.col(row_id).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(row_id).alias("doc_id"),
        (F.octet_length(content) + 16).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    placed = written(place(rows, key, shards, added), "placed")
    return slots(placed, ["doc_id", "text_crc32", "size"])
