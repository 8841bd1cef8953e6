"""Near-duplicate join on word n-grams: MinHash bands propose, full n-gram sets decide.

Texts are sets of hashed runs of ``NGRAM`` words; a text with fewer words is one run. Equal
texts are combined first, so all work is between distinct texts (nodes). Each node's
MinHash values are cut into bands; band and row counts follow from the recall wanted at
the threshold. Rows are shuffled on band hashes, and every member of a bucket is tied to
the bucket's smallest node: enough to connect all candidates, and never more rows than
members. Connected candidates then meet in one group, where all pairs among them are
verified on their full sets at once, as a matrix product. A group above ``BLOCK_ROWS`` texts or
``BLOCK_BYTES`` is cut into blocks, and each pair of blocks is a task of its own. Pairs
themselves are never put out, only the sums and the classes that they form.

Null text counts as empty. A text without a word has no n-grams, no links, and is a class
of its own. Equal texts are linked with each other. Rows of one null or repeated id are
separate documents if their texts differ. Texts of any length are read whole. N-grams and texts
are told apart by hashes of 64 and 128 bits, which are mixed, not added up, so that no pattern
of words makes them equal. An empty table gives an empty table. Input columns are chosen by
name, others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.support import spread_join, text_key, whole, written
from tickloom.llm.word_hashes import batches_of_words, mix, run_hashes

NGRAM = 5
# Similarity from which texts are linked, in per cent.
PERCENT = 80
# Share of the pairs at the threshold that share a band; more similar pairs have more.
RECALL = 0.9999
# At most so many MinHash values per text.
HASHES = 256
BLOCK_ROWS, BLOCK_BYTES = 500, 8 << 20


def band_counts(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """The most rows per band, and the bands they need, to find a pair at the threshold."""
    best = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows > hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall with so few hashes")
    return best


def gram_set(hashes: np.ndarray) -> np.ndarray:
    """The set of n-grams of a text from its words' hashes, sorted."""
    if not len(hashes):
        return hashes
    return np.unique(run_hashes(hashes, min(NGRAM, len(hashes))))


def signer(bands: int, rows: int):
    """A function from an n-gram set to the hashes of its bands."""
    random = np.random.default_rng(11)
    factor = random.integers(0, 1 << 31, (bands * rows, 1), dtype=np.uint32) * np.uint32(2)
    factor += np.uint32(1)
    shift = random.integers(0, 1 << 32, (bands * rows, 1), dtype=np.uint32)
    weights = random.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2)
    weights += np.uint64(1)
    number = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def sign(grams: np.ndarray) -> np.ndarray:
        low = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
        short = (grams >> np.uint64(32)).astype(np.uint32)
        for a in range(0, len(short), 1024):
            part = factor * short[None, a : a + 1024]
            part += shift
            np.minimum(low, part.min(axis=1), out=low)
        table = low.reshape(bands, rows).astype(np.uint64)
        return mix((table * weights).sum(axis=1, dtype=np.uint64) + number).view(np.int64)

    return sign


def distinct_texts(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row per distinct text: key, node (a number), rep (least id), copies, bytes, empty."""
    content = whole(text)
    each = docs.select(
        text_key(content).alias("key"),
        F.col(row_id).alias("id"),
        F.octet_length(content).alias("bytes"),
        (~F.rlike(content, F.lit(r"[^\x20\x09-\x0D]"))).alias("empty"),
    )
    found = each.groupBy("key").agg(
        F.min("id").alias("rep"),
        F.count(F.lit(1)).alias("copies"),
        F.max("bytes").alias("bytes"),
        F.max("empty").alias("empty"),
    )
    return written(found.withColumn("node", F.monotonically_increasing_id()), "texts")


def band_table(docs: DataFrame, text: str) -> DataFrame:
    """Per text: key and the hashes of its bands; a task puts out each text once."""
    bands, rows = band_counts(PERCENT / 100, RECALL, HASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, seen = signer(bands, rows), set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, hashes, at in batches_of_words(batch.column(1)):
                out = []
                for k in range(len(at) - 1):
                    key = keys[first + k]
                    if at[k + 1] > at[k] and key not in seen:
                        seen.add(key)
                        out.append((key, sign(gram_set(hashes[at[k] : at[k + 1]]))))
                if out:
                    values = pa.array(np.concatenate([b for _, b in out]))
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.arange(len(out) + 1, dtype=np.int32) * bands), values
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for k, _ in out], pa.binary()), lists], ["key", "bands"]
                    )

    content = whole(text)
    rows_in = docs.select(text_key(content).alias("key"), content.alias("text"))
    return rows_in.mapInArrow(run, "key binary, bands array<long>")


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """Ties between each bucket's smallest node and its other nodes (a > b).

    ``nodes`` has node and bands; it is read twice and should be a written table.
    """
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = (
        rows.groupBy("bucket")
        .agg(F.min("node").alias("b"), F.max("node").alias("_last"))
        .where("b < _last")
        .select("bucket", "b")
    )
    ties = rows.join(shared, "bucket").where("node > b")
    return ties.select(F.col("node").alias("a"), "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a > b): node and label, its component's least node.

    Every round ties the neighbours of a node to the least of them, first those above it,
    then those below, until nothing changes; then all edges point to the least node. Each
    step is written to the shared folder, and only a count and a checksum come back. As the
    least neighbours are a table of their own, adaptive execution can split the many edges of
    one node in the join.
    """

    def fingerprint(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = written(edges, "edges")
    before, now = None, fingerprint(edges)
    while now != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), "_m")
        large = written(large.where("a > _m").withColumnRenamed("_m", "b").distinct(), "edges")
        below = written(large.groupBy("a").agg(F.min("b").alias("_m")), "least")
        tied = large.join(below, "a")
        small = tied.where("b > _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
        small = small.unionByName(below.withColumnRenamed("_m", "b")).distinct()
        edges = written(small, "edges")
        before, now = now, fingerprint(edges)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share, from products of 0/1 matrices."""
    k = len(sets)
    shared = np.zeros((k, k), np.float32)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[column] > 1
    owner, column = owner[several], column[several]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    _, column = np.unique(column, return_inverse=True)
    width = 2048
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        present, row = np.unique(owner[a:b], return_inverse=True)
        matrix = np.zeros((len(present), width), np.float32)
        matrix[row, column[a:b] - first] = 1
        shared[np.ix_(present, present)] += matrix @ matrix.T
    return shared


def verify(part: pa.Table) -> pa.Table:
    """Links inside a group, or between its two blocks: node, links, label.

    ``links`` counts the documents of linked texts, ``label`` is the least linked node
    that can be reached inside the group.
    """
    part = part.combine_chunks()
    node = part["node"].to_numpy()
    _, only = np.unique(node, return_index=True)
    part, node = part.take(only), node[only]
    copies, block = part["copies"].to_numpy(), part["block"].to_numpy()
    first, second = part["i"][0].as_py(), part["j"][0].as_py()
    sets: list[np.ndarray] = []
    for _, hashes, at in batches_of_words(part["text"].combine_chunks()):
        sets += [gram_set(hashes[at[k] : at[k + 1]]) for k in range(len(at) - 1)]
    shared = overlaps(sets)
    size = np.array([len(s) for s in sets], np.float64)
    linked = 100 * shared >= PERCENT * (size[:, None] + size[None, :] - shared)
    np.fill_diagonal(linked, False)
    if first != second:
        linked &= block[:, None] != block[None, :]
    some = linked.any(axis=1)
    linked, node, copies = linked[np.ix_(some, some)], node[some], copies[some]
    links = linked @ copies.astype(np.int64) if len(node) else np.zeros(0, np.int64)
    label = node.copy()
    while len(label):
        least = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        least = np.minimum(label, least)
        if (least == label).all():
            break
        label = least
    return pa.table({"node": node, "links": links.astype(np.int64), "label": label})


def verified(docs: DataFrame, texts: DataFrame, groups: DataFrame, row_id: str, text: str):
    """Verified links among candidates: node, links, label, one row per group it is in."""
    members = texts.join(groups, "node")
    sizes = members.groupBy("label").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES)
        ).cast("int").alias("blocks")
    )
    dealt = (
        members.join(sizes, "label")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select("key", "node", "rep", "copies", "label", "block", "blocks")
    )
    content = whole(text)
    rows = docs.select(
        text_key(content).alias("key"), F.col(row_id).alias("id"), content.alias("text")
    )
    placed = (
        rows.join(dealt, "key")
        .where(F.col("id").eqNullSafe(F.col("rep")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        # A group of several blocks checks each of them alone once, in its pair with itself.
        .select("label", "i", "j", "node", "copies", "block", "text")
    )
    schema = "node long, links long, label long"
    return placed.groupBy("label", "i", "j").applyInArrow(verify, schema)


def near_texts(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per distinct text: key, node, rep, copies, empty, links, label (its class's least node)."""
    texts = distinct_texts(docs, row_id, text)
    nodes = written(band_table(docs, text).join(texts, "key").select("node", "bands"), "bands")
    groups = components(candidate_edges(nodes))
    found = written(verified(docs, texts, groups, row_id, text), "links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(
        found.where("node > label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    )
    return (
        texts.join(sums, "node", "left")
        .join(labels, "node", "left")
        .select(
            "key", "node", "rep", "copies", "empty",
            F.coalesce("links", F.lit(0)).alias("links"),
            F.coalesce("label", "node").alias("label"),
        )
    )


def classes(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, class_id (least id of its class), n_links, n_copies.

    ``n_links`` counts the other documents whose n-gram sets are similar, equal ones
    included.
    """
    near = written(near_texts(docs, row_id, text), "near")
    least = near.groupBy("label").agg(F.min("rep").alias("class_id"))
    known = written(
        near.join(least, "label").select(
            "key",
            "copies",
            F.when(~F.col("empty"), F.col("class_id")).alias("class_id"),
            F.when(F.col("empty"), 0).otherwise(F.col("links") + F.col("copies") - 1).alias(
                "n_links"
            ),
            "empty",
        ),
        "classes",
    )
    rows = docs.select(F.col(row_id).alias("doc_id"), text_key(whole(text)).alias("_key"))
    named = known.withColumnRenamed("key", "_key")
    return spread_join(rows, named, "_key", "copies", ["doc_id"]).select(
        "doc_id",
        F.when(F.col("empty"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.col("n_links").cast("long"),
        F.col("copies").alias("n_copies"),
    )


def keep_one(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without all but one of each class, with their columns as they are.

    The text with the least id stays, the least node between equal ids. Rows with that very
    text stay with it, as exact copies are not sought here; so do texts without a word.
    """
    near = written(near_texts(docs, row_id, text), "near")
    order = F.struct(F.col("rep").isNull(), "rep", "node")
    best = near.groupBy("label").agg(F.min(order).alias("_b"))
    drop = (
        near.join(best, "label")
        .where((F.col("node") != F.col("_b.node")) & ~F.col("empty"))
        .select(F.col("key").alias("_key"))
    )
    return docs.join(drop, text_key(whole(text)) == drop["_key"], "left_anti")
