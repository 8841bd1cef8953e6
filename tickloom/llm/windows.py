"""Substring dedup by level-wise doubling of repeated word windows.

A word goes if it is covered by a window of ``WINDOW`` words whose sequence also starts
anywhere else, in another text or in the same one. Windows are found level by level, at
lengths that double up to ``WINDOW``: 9, 18, 35 words. At each level a window is
represented by the least hash among its runs of that length. Equal windows have equal least runs,
so only windows whose run occurs elsewhere are extended to the next length; the last level
is the window itself. As neighbouring windows mostly share their least run, the first
level shuffles one row per about 14 words, and the others only what is left. Longer
repeats are unions of repeated windows, so nothing survives beyond the last level.

Copies of a whole text are found by a digest first. All of them go if they have a window;
one of them stays in the search for the sake of other texts.

Null text counts as empty; texts with fewer than ``WINDOW`` words lose nothing. Rows with
equal text have equal results, whatever their id. An empty table gives an empty table.
Runs are compared by 64-bit hashes, mixed piece by piece from their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.support import text_key, whole, written
from tickloom.llm.word_hashes import batches_of_words, run_hashes

WINDOW = 35


def lengths(window: int) -> list[int]:
    """Run lengths of the levels: each about twice the one before, the last the window."""
    found = [window]
    while found[0] > 12:
        found.insert(0, (found[0] + 1) // 2)
    return found


def extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or largest of every ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return pick(values[:-rest], values[rest:]) if rest else values


def least_runs(hashes: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All runs of a length, and the least run of each window."""
    runs = run_hashes(hashes, length)
    return runs, extreme(runs, window - length + 1, np.minimum)


def chosen(runs: np.ndarray, least: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """The runs that are the least of a window that is alive, once per place."""
    pad = np.zeros(len(runs) - len(least), np.uint64)
    reach = np.concatenate([pad, np.where(alive, least, np.uint64(0)), pad])
    return runs[extreme(reach, len(pad) + 1, np.maximum) == runs]


def anchors(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs, and whether the text has each in two places or more."""
    found, count = np.unique(runs, return_counts=True)
    return found.view(np.int64), count > 1


def ranges(mask: np.ndarray) -> list[int]:
    """A mask as start, end, start, end..."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edges.tolist()


def masked(edges: list[int], size: int) -> np.ndarray:
    steps = np.zeros(size + 1, np.int8)
    steps[edges[0::2]] += 1
    steps[edges[1::2]] -= 1
    return np.cumsum(steps[:-1]).astype(bool)


def first_anchors(docs: DataFrame, text: str, window: int) -> DataFrame:
    """Per text: small, runs, twice, at the first level. A task puts out each text once."""
    length = lengths(window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            small = batch.column(0).to_pylist()
            for first, hashes, at in batches_of_words(batch.column(1)):
                rows = []
                for k in range(len(at) - 1):
                    own = hashes[at[k] : at[k + 1]]
                    if len(own) < window or small[first + k] in seen:
                        continue
                    seen.add(small[first + k])
                    runs, least = least_runs(own, length, window)
                    picked = chosen(runs, least, np.ones(len(least), bool))
                    rows.append((small[first + k], *anchors(picked)))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[0] for r in rows]),
                            pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                            pa.array([r[2] for r in rows], pa.list_(pa.bool_())),
                        ],
                        ["small", "runs", "twice"],
                    )

    content = whole(text)
    rows_in = docs.select(F.xxhash64(content).alias("small"), content.alias("text"))
    return rows_in.mapInArrow(run, "small long, runs array<long>, twice array<boolean>")


def shared_runs(table: DataFrame) -> DataFrame:
    """Per text the runs that another text has too, or the text itself in two places.

    ``table`` (small, runs, twice) is read twice and should be a written table. One row per
    run, text and task is counted, so a passage that every text has is combined in each
    task before the shuffle; adaptive execution splits its rows in the join.
    """
    rows = table.select("small", F.explode(F.arrays_zip("runs", "twice")).alias("r")).select(
        "small", F.col("r.runs").alias("run"), F.col("r.twice").alias("twice")
    )
    shared = (
        rows.groupBy("run")
        .agg(F.min("small").alias("a"), F.max("small").alias("b"), F.max("twice").alias("twice"))
        .where("a < b OR twice")
        .select("run")
    )
    return (
        rows.select("small", "run")
        .join(shared, "run")
        .groupBy("small")
        .agg(F.collect_set("run").alias("shared"))
    )


STATE = (
    "doc_id long, small long, witness boolean, text string, alive array<int>, "
    "runs array<long>, twice array<boolean>, n_words long, removed array<int>, kept string"
)


def result(words: list[bytes], gone: np.ndarray) -> tuple[int, list[int], str]:
    """Number of words, ranges of removed words, and the kept ones."""
    kept = [word for word, out in zip(words, gone.tolist()) if not out]
    return len(gone), ranges(gone), b" ".join(kept).decode("utf-8")


def advance(rows: DataFrame, before: int, after: int | None, window: int) -> DataFrame:
    """Judge windows by the runs of one level, and lay out the runs of the next one.

    ``rows`` has doc_id, small, witness, copies, text, alive (ranges of windows, null for
    all) and shared. Texts without a shared run are done, and so are those of several
    copies, of which one goes on as a witness without a result. After the last level
    (``after`` is null) all are done.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, small, witness, copies = (batch.column(i).to_pylist() for i in range(4))
            texts, alive, shared = batch.column(4), batch.column(5).to_pylist(), batch.column(6)
            for first, hashes, at in batches_of_words(texts):
                out = []
                for k in range(len(at) - 1):
                    i = first + k
                    own, text = hashes[at[k] : at[k + 1]], texts[i].as_py()
                    many = copies[i] is not None and copies[i] > 1
                    head = (ids[i], small[i])
                    if many or (not witness[i] and not shared[i].is_valid):
                        gone = np.full(len(own), many and len(own) >= window)
                        done = result(text.encode().split(), gone)
                        out.append((*head, False, None, None, None, None, *done))
                    if not shared[i].is_valid or (many and not witness[i]):
                        continue
                    known = np.sort(shared[i].values.to_numpy(zero_copy_only=False)).view(np.uint64)
                    _, least = least_runs(own, before, window)
                    good = np.isin(least, known)
                    if alive[i] is not None:
                        good &= masked(alive[i], len(good))
                    if after is None:
                        if not witness[i]:
                            steps = np.zeros(len(own) + 1, np.int64)
                            steps[:-window] += good
                            steps[window:] -= good
                            done = result(text.encode().split(), np.cumsum(steps[:-1]) > 0)
                            out.append((*head, False, None, None, None, None, *done))
                        continue
                    runs, least = least_runs(own, after, window)
                    found, twice = anchors(chosen(runs, least, good))
                    out.append(
                        (*head, witness[i], text, ranges(good), found, twice, None, None, None)
                    )
                if out:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, fields)],
                        [f.name for f in fields],
                    )

    fields = [
        pa.field("doc_id", pa.int64()), pa.field("small", pa.int64()),
        pa.field("witness", pa.bool_()), pa.field("text", pa.string()),
        pa.field("alive", pa.list_(pa.int32())), pa.field("runs", pa.list_(pa.int64())),
        pa.field("twice", pa.list_(pa.bool_())), pa.field("n_words", pa.int64()),
        pa.field("removed", pa.list_(pa.int32())), pa.field("kept", pa.string()),
    ]
    columns = ["doc_id", "small", "witness", "copies", "text", "alive", "shared"]
    return rows.select(*columns).mapInArrow(run, STATE)


def remove_repeats(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """Per document: doc_id, n_words, removed (ranges of words: start, end...), kept.

    ``kept`` is the text of the words that stay, joined by one space.
    """
    content = whole(text)
    levels = lengths(window)
    runs = written(first_anchors(docs, text, window), "runs")
    shared = written(shared_runs(runs), "shared")
    named = docs.select(
        F.col(row_id).cast("long").alias("doc_id"),
        text_key(content).alias("key"),
        F.xxhash64(content).alias("small"),
        content.alias("text"),
    )
    texts = named.groupBy("key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("rep"), F.min("small").alias("small")
    )
    marks = (
        texts.join(shared, "small", "left")
        .where("copies > 1 OR shared IS NOT NULL")
        .select("key", "copies", "rep", "shared")
    )
    # Adaptive execution splits the rows of a text that very many documents have.
    state = named.join(marks, "key", "left").select(
        "doc_id",
        "small",
        ((F.col("copies") > 1) & F.col("doc_id").eqNullSafe(F.col("rep"))).alias("witness"),
        "copies",
        "text",
        F.lit(None).cast("array<int>").alias("alive"),
        "shared",
    )
    state = state.na.fill(False, ["witness"])
    done = []
    for before, after in zip(levels, levels[1:]):
        table = written(advance(state, before, after, window), "windows")
        done.append(table.where("n_words IS NOT NULL"))
        left = table.where("n_words IS NULL")
        shared = written(shared_runs(left), "shared")
        state = left.drop("runs", "twice", "n_words", "removed", "kept").join(
            shared, "small", "left"
        ).withColumn("copies", F.lit(None).cast("long"))
    result = advance(state, levels[-1], None, window)
    for part in done:
        result = result.unionByName(part)
    return result.select("doc_id", "n_words", "removed", "kept")


def window_table(docs: DataFrame) -> DataFrame:
    """Word counts and the digest of what stays of every document."""
    pairs = F.transform(
        "removed", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)
    )
    return remove_repeats(docs).select(
        "doc_id",
        "n_words",
        F.aggregate(pairs, F.lit(0), lambda total, x: total + x).cast("long").alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# Words have no spaces, so joined words are equal if and only if the words are.
ORACLE = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS MATERIALIZED (
  SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS words
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
f AS (SELECT r, i, count(*) OVER (PARTITION BY words) > 1 AS again FROM s),
c AS (
  SELECT r, i, word,
         coalesce(bool_or(again) OVER (
           PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), false) AS gone
  FROM p LEFT JOIN f USING (r, i)),
k AS (
  SELECT r, count(*) FILTER (gone) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM c GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
