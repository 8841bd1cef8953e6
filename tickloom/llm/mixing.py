"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a share of the budget by its weight, at most ``EPOCHS`` times its size;
what exceeds that is shared again among the others. A source is taken whole as often as
it fits into its target. For the rest, documents are counted by their exact length, and every
length gives its proportional number of documents. What these numbers were rounded down by
are the lengths' chances in a seeded order. One more document of each length is taken in
this order while more than ``FILL`` words are missing; then bounded-knapsack dynamic programming
over the counts that are left, in the same order, fills the remaining budget to the word, or
as near below it as lengths allow. So which lengths are mixed depends on the seed at any
size of the source. Which documents of a length are taken is decided by a seeded hash of id
and text.

Null sources form one source, last in order; null text has no words. Rows without a word
are neither needed nor in the way: they are taken as often as their whole source. Rows
equal in id and text are interchangeable. Texts of any length are counted whole. An empty
table gives an empty table. Input columns are chosen by name; others may have any name and are
carried along by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.support import whole, word_count, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2
SEED = 20_240_501
# The dynamic programming starts with a budget of this many words, and at most twice it.
FILL = 1 << 15


def source_key(column: str) -> Column:
    """A text without null that sorts as the source does, null last."""
    source = F.col(column).cast("string")
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def targets(totals: DataFrame, weights: Sequence[float], share: float, epochs: int) -> DataFrame:
    """The target of each source: _source, source_size, target.

    ``totals`` has one row per source (_source, source_size), and weights repeat in the
    order of sources. Sources reach their cap in the order of cap over weight, so running
    sums in that order show at which level the budget is used up. There is one narrow row
    per source here, never one per document.
    """
    ordered = Window.orderBy("_source")
    place = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    table = F.array(*[F.lit(float(w)) for w in weights])
    cap = F.col("source_size") * float(epochs)
    ranked = (
        totals.withColumn("_weight", F.get(table, place))
        .withColumn("_cap", cap)
        .withColumn("_ratio", cap / F.col("_weight"))
    )
    budget = totals.agg(F.sum("source_size") * float(share)).scalar()
    all_weight = ranked.agg(F.sum("_weight")).scalar()
    before = Window.orderBy("_ratio", "_source").rowsBetween(Window.unboundedPreceding, -1)
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        all_weight - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    )
    capped = ranked.withColumn("_capped", F.col("_ratio") <= level)
    everyone = Window.partitionBy()
    used = F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(everyone)
    open_weight = F.sum(F.when(~F.col("_capped"), F.col("_weight")).otherwise(0.0)).over(everyone)
    return capped.select(
        "_source",
        "source_size",
        F.when(F.col("_capped"), F.col("_cap"))
        .otherwise(F.col("_weight") * (budget - used) / open_weight)
        .alias("target"),
    )


def fill(
    lengths: list[int], spare: list[int], budget: int, order: list[int] | None = None
) -> list[int]:
    """How many documents of each length to take so that they sum up to the budget.

    Lengths descend; ``order`` says which come first, all of them one document each, then the
    others in groups of 1, 2, 4... A table of reachable sums gives the largest one that is
    not above the budget, and sums are made of what came first. Budgets above twice ``FILL``
    words are brought down to that many words by whole lengths before.
    """
    import numpy as np

    order = list(range(len(lengths))) if order is None else order
    taken = [0] * len(lengths)
    for keep in (FILL, 0):
        if budget <= 2 * FILL:
            break
        for i in order:
            if budget - keep >= lengths[i]:
                n = min(spare[i] - taken[i], (budget - keep) // lengths[i])
                taken[i] += n
                budget -= n * lengths[i]
    if budget <= 0 or budget > 2 * FILL:
        return taken
    left = [min(s - t, budget // length) for s, t, length in zip(spare, taken, lengths, strict=True)]
    groups = [(i, 1) for i in order if left[i] > 0]
    for i in order:
        rest, size = left[i] - 1, 1
        while rest > 0:
            groups.append((i, min(size, rest)))
            rest -= size
            size *= 2
    # For each sum, the group of documents that reached it first.
    first = np.full(budget + 1, -1, dtype=np.int64)
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    for g, (i, n) in enumerate(groups):
        step = n * lengths[i]
        if step <= budget:
            fresh = np.flatnonzero(reached[:-step] & ~reached[step:]) + step
            first[fresh] = g
            reached[fresh] = True
        if reached[budget]:
            break
    total = int(np.flatnonzero(reached)[-1])
    while total:
        i, n = groups[first[total]]
        taken[i] += n
        total -= n * lengths[i]
    return taken


def seeded_order(lengths: list[int], parts: list[int], size: int, salt: str) -> list[int]:
    """Places of lengths, by a hash between 0 and 1 over the chance of each (a part of size)."""
    known = [
        (xxhash.xxh64_intdigest(f"{salt} {length}") / (1 << 64) * size / max(part, 0.5), i)
        for i, (length, part) in enumerate(zip(lengths, parts, strict=True))
    ]
    return [i for _, i in sorted(known)]


def fit(
    lengths: list[int], counts: list[int], budget: int, size: int, salt: str = f"{SEED}"
) -> list[int]:
    """How many documents of each (descending) length make up a part of a source."""
    taken = [c * budget // size for c in counts]
    left = budget - sum(n * length for n, length in zip(taken, lengths, strict=True))
    parts = [c * budget % size for c in counts]
    order = seeded_order(lengths, parts, size, salt)
    for i in order:
        if left - FILL >= lengths[i] and parts[i]:
            taken[i] += 1
            left -= lengths[i]
    more = fill(lengths, [c - n for c, n in zip(counts, taken, strict=True)], left, order)
    return [n + m for n, m in zip(taken, more, strict=True)]


def fit_source(part: pd.DataFrame, seed: int = SEED) -> pd.DataFrame:
    """Choose the lengths of one source. A source of n words has at most sqrt(2 n) lengths."""
    part = part.sort_values("size", ascending=False)
    size, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
    rest = round(target - int(target // size) * size)
    lengths, counts = part["size"].tolist(), part["n"].tolist()
    salt = f"{seed} {part['_source'].iloc[0]}"
    part["picks"] = fit(lengths, counts, rest, size, salt) if rest > 0 else 0
    return part[["_source", "size", "picks"]]


def copies(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    row_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """The documents as a struct ``row``, with size, source_size, target and copies.

    Documents are dealt by source, length and a range of the seeded hash. Counts per range
    tell how many documents each range gives, so that ranking stays inside a range. The
    result does not depend on the number of ranges.
    """
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chance = F.xxhash64(F.lit(seed), F.col(row_id), F.col(text))
    # The top 24 bits as a fraction of 2^24, times the number of ranges.
    cut = F.shiftright((F.shiftright(chance, 40) + (1 << 23)) * ranges, 24).cast("int")
    sized = docs.select(
        F.struct(*docs.columns).alias("row"),
        source_key(source).alias("_source"),
        word_count(whole(text)).alias("size"),
        chance.alias("_chance"),
        cut.alias("_range"),
    )
    keys = ["_source", "size", "_range"]
    counted = written(sized.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = counted.groupBy("_source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = written(targets(totals, weights, share, epochs), "targets")
    by_length = counted.where("size > 0").groupBy("_source", "size").agg(F.sum("n").alias("n"))
    picks = (
        by_length.join(goals, "_source")
        .groupBy("_source")
        .applyInPandas(lambda part: fit_source(part, seed), "_source string, size long, picks long")
    )
    before = Window.partitionBy("_source", "size").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    earlier = F.coalesce(F.sum("n").over(before), F.lit(0))
    quota = F.greatest(F.lit(0), F.least(F.col("n"), F.coalesce("picks", F.lit(0)) - earlier))
    quotas = (
        counted.join(picks, ["_source", "size"], "left")
        .select(*keys, quota.alias("_quota"))
        .join(goals, "_source")
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_chance"))
    size = F.greatest(F.col("source_size"), F.lit(1))
    return sized.join(written(quotas, "quotas"), keys).select(
        "row",
        "size",
        "source_size",
        "target",
        (F.floor(F.col("target") / size) + (rank <= F.col("_quota")).cast("int"))
        .cast("int")
        .alias("copies"),
    )


def mix_table(docs: DataFrame, **options) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken."""
    narrow = docs.select("doc_id", "text", "source")
    return copies(narrow, **options).select(
        F.col("row.doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken."""
    chosen = copies(docs, **options).where("copies > 0")
    return chosen.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
