"""Near duplicates by HyperMinHash: compressed registers propose, full shingle sets decide.

A text's set are its distinct runs of ``SHINGLE`` words, A-Z in lower case, as 64-bit hashes
(a text with fewer words is one run). Equal sets are combined first; all work is
between distinct sets (nodes). Every element falls into one of the registers, which keeps its
least value as the number of leading zeros and the ``MANTISSA`` bits behind them: two bytes.

1. Registers are cut into bands, whose shape follows from the recall wanted at the threshold.
   For banding, empty registers take the value of another one, chosen by a fixed
   order of all registers, so that small sets are as hard to confuse as large ones. Nodes meet
   in buckets of equal bands.
2. Every bucket compares its members with one of them: linear work, after which the members of
   large groups of near copies mostly share a label that says they are connected.
3. Of buckets whose other members still have several labels, all members outside the most
   common label are compared with all members by their registers, in blocks. What the estimate
   does not rule out is connected into groups, and verified in blocks, again without the pairs
   inside a label. Pairs are never put out, only the components they connect.

The estimate subtracts the expected number of registers that agree by chance, and rules a
pair out only ``DEVIATIONS`` standard deviations below the threshold. Links are decided on
full sets, in integers. A pair at the threshold is missed with probability 1 - ``RECALL``.

Null text counts as empty. A text without a word has no set, no links and is its own component.
Texts whose sets are equal are linked. Rows of one null or repeated id are separate documents;
a null id is never the least of a component unless all its ids are null, and a document
with a null id is kept only then. Texts of any length are read whole. An empty table gives an
empty table. Input columns are chosen by name, others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.jaccard import band_counts, components
from tickloom.llm.support import spread_join, text_key, whole, written
from tickloom.llm.word_hashes import batches_of_words, mix, run_hashes

SHINGLE = 3
# Similarity from which sets are linked, in per cent.
PERCENT = 85
RECALL = 0.999999
# At most so many registers.
REGISTERS = 256
MANTISSA = 10
DEVIATIONS = 6
# Whether buckets are compared with one member first; it changes the work, not the result.
STARS = True
# How often a label is replaced by its own label.
JUMPS = 2
# Members of a block, of their sets in bytes, and of their registers.
BLOCK_ROWS, BLOCK_BYTES, BLOCK_REGISTERS = 256, 16 << 20, 1_000

BANDS, ROWS = band_counts(PERCENT / 100, RECALL, REGISTERS)
SIZE = BANDS * ROWS
EMPTY = 0xFFFF
_LEVELS = 54

_random = np.random.default_rng(17)
# For every register the order in which it looks at the others when it is empty.
_ORDER = np.argsort(_random.random((SIZE, SIZE)), axis=1).argsort(axis=1).astype(np.uint16)
_WEIGHTS = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NUMBERS = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The sorted set of a text from its words' hashes."""
    return np.unique(run_hashes(hashes, min(SHINGLE, len(hashes)))) if len(hashes) else hashes


def registers(elements: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the least value in each register, ``EMPTY`` without one."""
    own = (mix(elements) >> np.uint64(32)) * np.uint64(SIZE) >> np.uint64(32)
    value = mix(elements ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(11)
    order = np.argsort(own, kind="stable")
    place, first = np.unique(own[order], return_index=True)
    least = np.minimum.reduceat(value[order], first) if len(first) else value
    zeros = (_LEVELS - 1) - np.frexp(least.astype(np.float64))[1].astype(np.int64)
    behind = least << (zeros + 1).astype(np.uint64) & np.uint64((1 << (_LEVELS - 1)) - 1)
    out = np.full(SIZE, EMPTY, np.uint16)
    out[place.astype(np.int64)] = (
        zeros.astype(np.uint64) << np.uint64(MANTISSA) | behind >> np.uint64(_LEVELS - 1 - MANTISSA)
    )
    return out


def filled(sketch: np.ndarray) -> np.ndarray:
    """Registers in which every empty one takes the value of the first full one in its order."""
    full = np.flatnonzero(sketch != EMPTY)
    empty = np.flatnonzero(sketch == EMPTY)
    out = sketch.copy()
    if len(full) and len(empty):
        out[empty] = sketch[full[_ORDER[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    table = filled(sketch).reshape(BANDS, ROWS).astype(np.uint64)
    return mix((mix(table) * _WEIGHTS).sum(axis=1, dtype=np.uint64) + _NUMBERS).view(np.int64)


def level_shares(sizes: np.ndarray) -> np.ndarray:
    """How likely a register has each number of leading zeros, for sets of these sizes."""
    filled_by = np.maximum(1.0, sizes / SIZE)[:, None]
    above = 1 - 0.5 ** np.arange(1, _LEVELS + 1)[None, :]
    upper = np.concatenate([np.zeros((1, 1)), above[:, :-1]], axis=1)
    return above**filled_by - upper**filled_by


def ruled_out(
    agree: np.ndarray, either: np.ndarray, chance: np.ndarray
) -> np.ndarray:
    """Whether a pair's similarity is below the threshold beyond doubt.

    ``agree`` of the ``either`` registers that one of both has are equal; ``chance`` is how
    likely different elements look the same in a register.
    """
    threshold = PERCENT / 100
    either = np.maximum(either, 1)
    estimate = (agree / either - chance) / (1 - chance)
    return estimate < threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / either)


def sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SIZE)


def lowered(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts)


def signed_documents(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """Per document: id, source (digest of its text), key (of its set), n, sketch.

    A task puts out the sketch of a set once. Key and sketch are null without a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys, counts, sketches = [], [], []
            for _, hashes, at in batches_of_words(lowered(batch.column(2))):
                for k in range(len(at) - 1):
                    own = shingles(hashes[at[k] : at[k + 1]])
                    counts.append(len(own))
                    key = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
                    keys.append(key)
                    fresh = key is not None and key not in seen
                    seen.add(key)
                    sketches.append(registers(own).tobytes() if fresh else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(keys, pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array(sketches, pa.binary()),
                ],
                ["id", "source", "key", "n", "sketch"],
            )

    content = whole(text)
    rows = docs.select(
        F.col(row_id).alias("id"), text_key(content).alias("source"), content.alias("text")
    )
    schema = T.StructType(
        [rows.schema["id"], T.StructField("source", T.BinaryType()),
         T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()),
         T.StructField("sketch", T.BinaryType())]
    )
    return written(rows.mapInArrow(run, schema), "signed")


def distinct_sets(signed: DataFrame) -> DataFrame:
    """One row per set: node, key, rep (least id), copies, n, sketch, source (of one text)."""
    found = signed.where("n > 0").groupBy("key").agg(
        F.min("id").alias("rep"),
        F.count(F.lit(1)).alias("copies"),
        F.max("n").alias("n"),
        F.max("sketch").alias("sketch"),
        F.min(F.struct("source", "id")).alias("source"),
    )
    return written(found.withColumn("node", F.monotonically_increasing_id()), "sets")


def bucket_table(sets: DataFrame) -> DataFrame:
    """Members of the buckets that two or more nodes share: bucket, band, node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bands = [band_hashes(s) for s in sketch_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(bands)),
                    pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(bands))),
                    pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)),
                ],
                ["bucket", "band", "node"],
            )

    rows = sets.select("node", "sketch").mapInArrow(run, "bucket long, band int, node long")
    members = rows.groupBy("bucket").agg(F.min("node").alias("_a"), F.max("node").alias("_b"))
    shared = members.where("_a < _b").select("bucket")
    return written(rows.join(shared, "bucket", "left_semi"), "buckets")


def element_table(docs: DataFrame, sets: DataFrame, nodes: DataFrame, row_id: str, text: str) -> DataFrame:
    """The full sets of some nodes: node, elements (8 bytes each, sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, hashes, at in batches_of_words(lowered(batch.column(1))):
                out += [shingles(hashes[at[k] : at[k + 1]]).tobytes() for k in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary())], ["node", "elements"]
            )

    content = whole(text)
    wanted = sets.join(nodes, "node", "left_semi").select(
        "node", F.col("source.source").alias("_source"), F.col("source.id").alias("_id")
    )
    rows = docs.select(
        text_key(content).alias("_source"), F.col(row_id).alias("_own"), content.alias("text")
    )
    chosen = rows.join(wanted, "_source").where(F.col("_own").eqNullSafe(F.col("_id")))
    return written(
        chosen.select("node", "text").mapInArrow(run, "node long, elements binary"), "elements"
    )


def dealt(tasks: DataFrame, rows: int, size: int) -> DataFrame:
    """Blocks of a group in which every minor member meets every member: i, j beside the columns.

    ``tasks`` has group, minor, node and bytes. A minor member is in all blocks (i, ·) with
    its own i, and as a member, like all others, in all blocks (·, j) with its own j.
    """

    def blocks(only: Column) -> Column:
        count, total = F.count(F.when(only, 1)), F.sum(F.when(only, F.col("bytes")))
        return F.greatest(
            F.lit(1), F.ceil(count / rows), F.ceil(F.coalesce(total, F.lit(0)) / size)
        ).cast("int")

    sizes = tasks.groupBy("group").agg(
        blocks(F.col("minor")).alias("_ni"), blocks(F.lit(True)).alias("_nj")
    )
    number = F.xxhash64("node")
    own_i, own_j = (F.pmod(number, F.col(c)).cast("int") for c in ("_ni", "_nj"))

    def blocks_of(minor: bool, count: str, i, j) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.col(count) - 1),
            lambda x: F.struct(F.lit(minor).alias("minor"), i(x).alias("i"), j(x).alias("j")),
        )

    as_member = blocks_of(False, "_ni", lambda x: x, lambda x: own_j)
    as_minor = blocks_of(True, "_nj", lambda x: own_i, lambda x: x)
    places = F.when(F.col("minor"), F.concat(as_member, as_minor)).otherwise(as_member)
    placed = tasks.join(sizes, "group").withColumn("_place", F.explode(places))
    kept = [c for c in tasks.columns if c != "minor"]
    return placed.select(*kept, "_place.minor", "_place.i", "_place.j")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each left set shares with each right set."""
    kind = np.float32 if max(map(len, left)) < 1 << 24 else np.float64
    out = np.zeros((len(left), len(right)), kind)
    words = np.unique(np.concatenate(left))
    pair = []
    for sets in (left, right):
        elements = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.searchsorted(words, elements)
        known = column < len(words)
        known[known] = words[column[known]] == elements[known]
        order = np.argsort(column[known], kind="stable")
        pair.append((owner[known][order], column[known][order]))
    width = 1024
    for first in range(0, len(words), width):
        matrices, rows = [], []
        for owner, column in pair:
            a, b = np.searchsorted(column, [first, first + width])
            present, row = np.unique(owner[a:b], return_inverse=True)
            matrix = np.zeros((len(present), width), kind)
            matrix[row, column[a:b] - first] = 1
            matrices.append(matrix)
            rows.append(present)
        out[np.ix_(*rows)] += matrices[0] @ matrices[1].T
    return out


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per name the least name connected with it, for names that are not the least.

    ``linked`` says which left and right rows are; equal names are one thing.
    """
    a, b = np.nonzero(linked)
    names, at = np.unique(np.concatenate([left[a], right[b]]), return_inverse=True)
    low = np.arange(len(names))
    a, b = at[: len(a)], at[len(a) :]
    while True:
        least = low.copy()
        np.minimum.at(least, a, low[b])
        np.minimum.at(least, b, low[a])
        least = least[least]
        if (least == low).all():
            break
        low = least
    moved = np.flatnonzero(low != np.arange(len(names)))
    return names[moved], names[low[moved]]


def edge_table(high: np.ndarray, low: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(high, pa.int64()), "b": pa.array(low, pa.int64())})


def halves(part: pa.Table) -> list[pa.Table]:
    """The minor members and the members of a block, each node once."""
    out = []
    for minor in (True, False):
        own = part.filter(pc.equal(part["minor"], minor))
        _, first = np.unique(own["node"].to_numpy(), return_index=True)
        out.append(own.take(first))
    return out


def verify(part: pa.Table) -> pa.Table:
    """Components connected by links between a block's minor members and its members."""
    sides = halves(part)
    sets = [
        [np.frombuffer(e, "<u8") for e in side["elements"].to_pylist()] for side in sides
    ]
    if not all(sets):
        return edge_table(np.zeros(0), np.zeros(0))
    shared = shared_counts(*sets).astype(np.float64)
    size = [np.array([len(s) for s in side], np.float64) for side in sets]
    linked = 100 * shared >= PERCENT * (size[0][:, None] + size[1][None, :] - shared)
    left, right = (side["label"].to_numpy() for side in sides)
    return edge_table(*forest(linked & (left[:, None] != right[None, :]), left, right))


def compare(part: pa.Table) -> pa.Table:
    """Nodes connected by pairs of a bucket that the estimate does not rule out.

    Pairs that share an earlier band meet in its bucket.
    """
    sides = halves(part)
    if not all(s.num_rows for s in sides):
        return edge_table(np.zeros(0), np.zeros(0))
    band = part["band"][0].as_py()
    left, right = (sketch_rows(s["sketch"]) for s in sides)
    share = [level_shares(s["n"].to_numpy()) for s in sides]
    chance = share[0] @ share[1].T / (1 << MANTISSA)
    labels = [s["label"].to_numpy() for s in sides]
    solid = [np.array([filled(s) for s in x])[:, : band * ROWS] for x in (left, right)]
    linked = np.zeros(chance.shape, bool)
    there = right != EMPTY
    for i, own in enumerate(left):
        agree = ((right == own) & there).sum(axis=1)
        either = (there | (own != EMPTY)).sum(axis=1)
        good = ~ruled_out(agree, either, chance[i]) & (labels[1] != labels[0][i])
        if band and good.any():
            rest = np.flatnonzero(good)
            same = (solid[1][rest] == solid[0][i]).reshape(len(rest), band, ROWS)
            good[rest[same.all(axis=2).any(axis=1)]] = False
        linked[i] = good
    return edge_table(*forest(linked, *(s["node"].to_numpy() for s in sides)))


def named(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with the component that their node is in so far."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    known = labels.select("node", F.col("label").alias("_label"))
    out = rows.join(known, "node", "left")
    return out.withColumn("label", F.coalesce("_label", "node")).drop("_label")


def links(tasks: DataFrame, sets: DataFrame, elements: DataFrame) -> DataFrame:
    """Links between components: a > b. ``tasks`` has group, minor, node and label."""
    sized = tasks.join(sets.select("node", (8 * F.col("n")).alias("bytes")), "node")
    blocks = dealt(sized, BLOCK_ROWS, BLOCK_BYTES).drop("bytes").join(elements, "node")
    found = blocks.groupBy("group", "i", "j").applyInArrow(verify, "a long, b long")
    return written(found.distinct(), "links")


def drawn_members(buckets: DataFrame) -> DataFrame:
    """One member of each bucket, the same in buckets with the same members."""
    order = F.struct(F.xxhash64("node"), "node")
    return buckets.groupBy("bucket").agg(F.min(order).alias("_p")).select(
        "bucket", F.col("_p.node").alias("drawn")
    )


def star_tasks(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Every bucket's drawn member with the members it may be similar to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = sketch_rows(batch.column(3)), sketch_rows(batch.column(4))
            share = [level_shares(batch.column(i).to_numpy()) for i in (5, 6)]
            agree = ((left == right) & (left != EMPTY)).sum(axis=1)
            either = ((left != EMPTY) | (right != EMPTY)).sum(axis=1)
            chance = (share[0] * share[1]).sum(axis=1) / (1 << MANTISSA)
            good = pa.array(~ruled_out(agree, either, chance))
            yield pa.RecordBatch.from_arrays(batch.columns[:3], ["group", "node", "label"]).filter(good)

    drawn = drawn_members(buckets).withColumnRenamed("drawn", "group")
    edges = buckets.join(drawn, "bucket").where(F.col("node") != F.col("group"))
    edges = edges.select("group", "node").distinct()
    sketches = sets.select("node", "sketch", "n")
    other = sets.select(
        F.col("node").alias("group"), F.col("sketch").alias("_sketch"), F.col("n").alias("_n")
    )
    near = written(
        edges.join(sketches, "node")
        .join(other, "group")
        .select("group", "node", F.col("node").alias("label"), "sketch", "_sketch", "n", "_n")
        .mapInArrow(run, "group long, node long, label long"),
        "near",
    )
    centres = near.select("group").distinct().select(
        "group", F.col("group").alias("node"), F.col("group").alias("label")
    )
    return near.withColumn("minor", F.lit(False)).unionByName(
        centres.withColumn("minor", F.lit(True))
    )


def pointers(links: DataFrame) -> DataFrame:
    """A label for linked nodes: nodes of one label are connected, if not the other way round."""
    low = links.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    for _ in range(JUMPS):
        low = written(low, "labels")
        step = low.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        low = low.join(step, "label", "left").select(
            "node", F.coalesce("_next", "label").alias("label")
        )
    return written(low, "labels")


def with_minors(rows: DataFrame) -> DataFrame:
    """Members of groups with several components; minor are those outside the largest one."""
    counts = rows.groupBy("group", "label").agg(F.count(F.lit(1)).alias("_n"))
    most = counts.groupBy("group").agg(
        F.max(F.struct("_n", "label")).alias("_m"), F.count(F.lit(1)).alias("_k")
    )
    most = most.where("_k > 1").select("group", F.col("_m.label").alias("_most"))
    return rows.join(most, "group").withColumn("minor", F.col("label") != F.col("_most")).drop("_most")


def group_tasks(buckets: DataFrame, sets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Groups of nodes whose registers leave a link between two labels possible.

    With labels, a bucket's drawn member has been compared with all others already.
    """
    members = buckets
    if labels is not None:
        members = members.join(drawn_members(buckets), "bucket").where("node != drawn").drop("drawn")
    rows = with_minors(named(members.withColumnRenamed("bucket", "group"), labels))
    blocks = dealt(rows.withColumn("bytes", F.lit(0)), BLOCK_REGISTERS, BLOCK_BYTES)
    near = (
        blocks.drop("bytes")
        .join(sets.select("node", "sketch", "n"), "node")
        .groupBy("group", "i", "j")
        .applyInArrow(compare, "a long, b long")
    )
    groups = components(near.distinct()).withColumnRenamed("label", "group")
    return with_minors(named(groups, labels))


def near_sets(docs: DataFrame, sets: DataFrame, row_id: str, text: str) -> DataFrame:
    """Nodes that are linked, directly or not: node, label (the least node)."""
    buckets = bucket_table(sets)
    elements = element_table(docs, sets, buckets.select("node"), row_id, text)
    if not STARS:
        rest = written(group_tasks(buckets, sets, None), "tasks")
        return components(links(rest, sets, elements))
    first = links(star_tasks(buckets, sets), sets, elements)
    rest = group_tasks(buckets, sets, pointers(first))
    return components(first.unionByName(links(written(rest, "tasks"), sets, elements)))


def near_duplicates(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least id of its component), kept."""
    signed = signed_documents(docs, row_id, text)
    sets = distinct_sets(signed)
    known = written(named(sets, written(near_sets(docs, sets, row_id, text), "labels")), "named")
    least = known.groupBy("label").agg(F.min("rep").alias("component"))
    known = written(known.join(least, "label").select("key", "copies", "component"), "components")
    rows = signed.select("id", "key", "n")
    out = spread_join(rows, known, "key", "copies", ["id"]).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
