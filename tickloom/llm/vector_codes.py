"""Vector compression by product codes, over Hilbert-sorted blocks with boxes and sums.

A component x counts as the integer floor(1024 * x). Vectors are cut into ``PARTS`` equal
consecutive parts (as equal as can be where the length does not divide), and each part
position has a codebook that starts from the vectors of the least ids. Rounds assign
every part to its nearest entry, ties to the lower one, and move each entry to the
floor of its parts' mean; entries without parts stay.

The parts of one position are sorted along a Hilbert curve and cut into blocks of
``BLOCK`` points, once. A block keeps the least and the largest value of each component and
the sums. In each round the distances from an entry to the near and the far side of the
box tell which entries can be nearest to any point of the block; only these are compared
with its points. A block with one such entry goes into the entry's sum as a whole. All
arithmetic is exact: floating point only where every intermediate value is an integer below
2^53, then 64-bit integers, then Python's, which values of any size fit.

The driver holds the codebooks, at most ``ENTRIES`` vectors. Equal points may fill any
number of blocks; the sort tells them apart by row number, so no task gets them all.

Vectors that are null, or hold null, NaN or infinite components, are dropped. So are those
whose length differs from that of the vector with the least id (and least components among
equal ids). Null ids come last in the order of ids. Repeated rows, null ids and null labels
are rows like others; vectors without components have distance 0. An error beyond 64 bits
is null, and so is the sum of a label that has one. An empty table gives an empty table.
Input columns are chosen by name, others may have any name.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.support import spread_join, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Points of a block.
BLOCK = 128
# Bits of a place on the curve.
CURVE_BITS = 60
# Bits of a limb, in which exact sums travel.
LIMB = 31

Books = list[list[list[int]]]


def finite(vector: Column) -> Column:
    """Whether a vector and all of its components are there and finite."""
    good = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def to_integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of doubles, as 64-bit integers if they have at most 31 bits."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    if not scaled.size or np.abs(scaled).max() < 1 << 31:
        return scaled.astype(np.int64)
    # Scaling by a power of two is exact; doubles too large for it are integers already.
    whole = [
        int(s) if np.isfinite(s) else int(v) * SCALE
        for s, v in zip(scaled.ravel().tolist(), values.ravel().tolist())
    ]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(values.shape)


def exact(arrays: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The arrays in a type in which their squared distances are exact."""
    reach = max([1, *(int(max(a.max(), -a.min())) for a in arrays if a.size)])
    bound = width * (2 * reach) ** 2
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
    return [a.astype(kind) for a in arrays]


def distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each point to each entry."""
    points, entries = exact([points, entries], max(1, points.shape[1]))
    if points.dtype == np.float64:
        cross = points @ entries.T
        return ((points * points).sum(1)[:, None] - 2 * cross) + (entries * entries).sum(1)[None, :]
    return np.stack([((points - e) ** 2).sum(1) for e in entries], axis=1)


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Per box and entry: whether the entry can be nearest to a point of the box."""
    low, high, entries = exact([low, high, entries], max(1, low.shape[1]))
    near = np.zeros((len(low), len(entries)), low.dtype)
    far = near.copy()
    for i in range(low.shape[1]):
        e = entries[None, :, i]
        below, above = low[:, i, None] - e, e - high[:, i, None]
        gap = np.maximum(np.maximum(below, above), 0)
        near = near + gap * gap
        reach = np.maximum(np.abs(below), np.abs(above))
        far = far + reach * reach
    return near <= far.min(axis=1)[:, None]


def hilbert(levels: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of coordinates with so many bits."""
    x = levels.astype(np.int64).T.copy()
    step = 1 << (bits - 1)
    while step > 1:
        rest = step - 1
        for axis in x:
            turned = (axis & step) != 0
            swap = np.where(turned, 0, (x[0] ^ axis) & rest)
            x[0] ^= np.where(turned, rest, swap)
            axis ^= swap
        step >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(1, bits):
        flip ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | (axis >> b & 1)
    return place


def part_bounds(width: int) -> list[int]:
    return [width * k // PARTS for k in range(PARTS + 1)]


def level_edges(seeds: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Per part: bits of a coordinate, and each coordinate's bounds between levels.

    Bounds are quantiles of the first codebook; they order the points, nothing else.
    """
    found, bounds = [], part_bounds(seeds.shape[1])
    for a, b in zip(bounds, bounds[1:]):
        table = seeds[:, a : min(b, a + CURVE_BITS)]
        bits = max(1, min(8, CURVE_BITS // max(1, table.shape[1])))
        share = np.arange(1, 1 << bits) / (1 << bits)
        found.append((bits, np.quantile(table, share, axis=0, method="lower")))
    return found


def stored(points: np.ndarray, values: np.ndarray) -> tuple[str, np.ndarray]:
    """A small type that holds the integers, or the doubles they come from."""
    if points.dtype == object:
        return "<f8", values
    small = not points.size or (points.min() >= -(1 << 15) and points.max() < 1 << 15)
    return ("<i2" if small else "<i4"), points


def loaded(kind: str, data: bytes, width: int) -> np.ndarray:
    table = np.frombuffer(data, kind).reshape(-1, width) if width else None
    if table is None:
        return np.zeros((0, 0), np.int64)
    return to_integers(table) if kind == "<f8" else table.astype(np.int64)


def lists(counts: list[int], values: pa.Array) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), values)


def block_table(rows: DataFrame, seeds: np.ndarray) -> DataFrame:
    """Blocks of points: part, kind, points, low, high, sums, and per point row, id, label.

    Ids and labels stand with the first part only.
    """
    width = seeds.shape[1]
    bounds, edges = part_bounds(width), level_edges(seeds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = batch.column(3).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            table = flat.reshape(n, width)
            for part in range(PARTS):
                values = np.ascontiguousarray(table[:, bounds[part] : bounds[part + 1]])
                bits, limits = edges[part]
                level = [np.searchsorted(limits[:, i], values[:, i])
                         for i in range(limits.shape[1])]
                curve = hilbert(np.array(level).T, bits) if level else np.zeros(n, np.int64)
                raw = values.astype("<f8").tobytes()
                size = 8 * values.shape[1]
                none = [pa.nulls(n, batch.column(i).type) for i in (1, 2)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(curve),
                        batch.column(0),
                        *(batch.columns[1:3] if part == 0 else none),
                        pa.array([raw[k * size : (k + 1) * size] for k in range(n)], pa.binary()),
                    ],
                    ["part", "curve", "row", "id", "label", "point"],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            turns = np.flatnonzero(np.diff(part)) + 1
            starts = [0, *turns.tolist(), batch.num_rows]
            pieces = [
                (a, min(a + BLOCK, stop))
                for begin, stop in zip(starts, starts[1:])
                for a in range(begin, stop, BLOCK)
            ]
            out = []
            for a, b in pieces:
                wide = bounds[part[a] + 1] - bounds[part[a]]
                raw = b"".join(batch.column(5).slice(a, b - a).to_pylist())
                values = np.frombuffer(raw, "<f8").reshape(b - a, wide)
                points = to_integers(values)
                kind, kept = stored(points, values)
                low, high = (
                    (values.min(0), values.max(0)) if kind == "<f8" else (points.min(0), points.max(0))
                )
                sums = None if kind == "<f8" else points.sum(0).astype("<i8").tobytes()
                out.append((int(part[a]), kind, b - a, kept.astype(kind).tobytes(),
                            low.astype(kind).tobytes(), high.astype(kind).tobytes(), sums))
            if out:
                columns = list(zip(*out))
                sizes = list(columns[2])
                types = (pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)]
                    + [lists(sizes, batch.column(i)) for i in (2, 3, 4)],
                    ["part", "kind", "size", "points", "low", "high", "sums",
                     "rows", "ids", "labels"],
                )

    kinds = {f.name: f.dataType for f in rows.schema.fields}
    carried = [T.StructField(n, kinds[n]) for n in ("id", "label")]
    point = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("curve", T.LongType()),
         T.StructField("row", T.LongType()), *carried, T.StructField("point", T.BinaryType())]
    )
    block = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("kind", T.StringType()),
         T.StructField("size", T.IntegerType())]
        + [T.StructField(n, T.BinaryType()) for n in ("points", "low", "high", "sums")]
        + [T.StructField("rows", T.ArrayType(T.LongType()))]
        + [T.StructField(f"{f.name}s", T.ArrayType(f.dataType)) for f in carried]
    )
    order = ["part", "curve", "row"]
    sorted_points = (
        rows.select("row", "id", "label", "vector")
        .mapInArrow(place, point)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
    return written(sorted_points.mapInArrow(cut, block), "blocks")


def judged(batch: pa.RecordBatch, books: list[np.ndarray]) -> Iterator[tuple]:
    """Per block of a batch: its number, part, points, nearest entries and distances.

    Points and distances are null for a block whose shortlist has one entry, unless asked
    for by a batch without sums.
    """
    part = batch.column("part").to_numpy()
    kinds = batch.column("kind").to_pylist()
    sums = batch.column("sums") if "sums" in batch.schema.names else None
    for p in np.unique(part).tolist():
        entries = books[p]
        width = entries.shape[1]
        for kind in sorted(set(kinds)):
            own = [i for i in np.flatnonzero(part == p).tolist() if kinds[i] == kind]
            if not own:
                continue
            low, high = (
                loaded(kind, b"".join(batch.column(n).take(pa.array(own)).to_pylist()), width)
                for n in ("low", "high")
            )
            if not width:
                low = high = np.zeros((len(own), 0), np.int64)
            for i, list_ in zip(own, shortlists(low, high, entries)):
                short = np.flatnonzero(list_)
                if sums is not None and len(short) == 1 and sums[i].is_valid:
                    yield i, p, None, short, None
                    continue
                points = loaded(kind, batch.column("points")[i].as_py(), width)
                if not width:
                    points = np.zeros((batch.column("size")[i].as_py(), 0), np.int64)
                apart = distances(points, entries[short])
                best = apart.argmin(axis=1)
                yield i, p, points, short[best], apart[np.arange(len(best)), best]


def limbs(values: np.ndarray) -> np.ndarray:
    """Integers as rows of limbs, the lowest first; the last row has the sign."""
    found = []
    while True:
        if values.dtype != object or max([0, *(abs(v) for v in values.tolist())]) < 1 << 62:
            values = values.astype(np.int64)
            return np.array([*found, values & ((1 << LIMB) - 1), values >> LIMB], np.int64)
        found.append(np.array([v & ((1 << LIMB) - 1) for v in values.tolist()], np.int64))
        values = values >> LIMB


def book_arrays(books: Books) -> list[np.ndarray]:
    found = []
    for entries in books:
        small = all(abs(v) < 1 << 31 for e in entries for v in e)
        table = np.empty((len(entries), len(entries[0])), np.int64 if small else object)
        table[:] = entries
        found.append(table)
    return found


def part_sums(blocks: DataFrame, books: Books) -> list[dict[int, tuple[int, list[int]]]]:
    """Per part and used entry: number and exact sums of the parts assigned to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = book_arrays(books)
        counts, totals = defaultdict(int), {}
        for batch in batches:
            for i, part, points, nearest, _ in judged(batch, arrays):
                if points is None:
                    size = batch.column("size")[i].as_py()
                    found = [(int(nearest[0]), size, np.frombuffer(batch.column("sums")[i].as_py(), "<i8"))]
                else:
                    order = np.argsort(nearest, kind="stable")
                    entries, first, size = np.unique(
                        nearest[order], return_index=True, return_counts=True
                    )
                    sums = np.add.reduceat(points[order], first, axis=0)
                    found = zip(entries.tolist(), size.tolist(), sums)
                for entry, size, sums in found:
                    key = part, entry
                    counts[key] += size
                    totals[key] = totals[key] + sums if key in totals else sums
        if totals:
            keys = list(totals)
            values = [np.concatenate([[counts[k]], limbs(totals[k]).ravel()]) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int32()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    lists([len(v) for v in values], pa.array(np.concatenate(values))),
                ],
                ["part", "entry", "sums"],
            )

    narrow = blocks.select("part", "kind", "size", "points", "low", "high", "sums")
    each = narrow.mapInArrow(run, "part int, entry int, sums array<long>")
    added = (
        each.select("part", "entry", F.posexplode("sums").alias("place", "value"))
        .groupBy("part", "entry", "place")
        .agg(F.sum("value").alias("value"))
    )
    out: list[dict] = [{} for _ in books]
    # At most as many rows as the codebooks have limbs.
    for row in added.collect():
        width = len(books[row.part][0])
        count, sums = out[row.part].get(row.entry, (0, [0] * width))
        if row.place == 0:
            count = row.value
        else:
            limb, i = divmod(row.place - 1, width)
            sums[i] += row.value << (LIMB * limb)
        out[row.part][row.entry] = count, sums
    return out


def trained(blocks: DataFrame, books: Books, rounds: int) -> Books:
    for _ in range(rounds):
        moved = part_sums(blocks, books)
        books = [
            [
                [s // found[e][0] for s in found[e][1]] if e in found else entry
                for e, entry in enumerate(entries)
            ]
            for entries, found in zip(books, moved)
        ]
    return books


def assigned(blocks: DataFrame, books: Books, row_type: T.StructType) -> DataFrame:
    """Per row: id, label, codes (entry per part), error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = book_arrays(books)
        for batch in batches:
            for i, part, _, nearest, apart in judged(batch, arrays):
                small = [int(d) if d < 1 << 63 else None for d in apart.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("rows")[i].values,
                        pa.array(np.full(len(nearest), part, np.int32)),
                        pa.array(nearest.astype(np.int32)),
                        pa.array(small, pa.int64()),
                        batch.column("ids")[i].values,
                        batch.column("labels")[i].values,
                    ],
                    ["row", "part", "entry", "apart", "id", "label"],
                )

    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("part", T.IntegerType()),
         T.StructField("entry", T.IntegerType()), T.StructField("apart", T.LongType()),
         T.StructField("id", row_type["id"].dataType),
         T.StructField("label", row_type["label"].dataType)]
    )
    found = blocks.drop("sums").mapInArrow(run, schema)

    def of(part: int, column: str) -> Column:
        return F.first(F.when(F.col("part") == part, F.col(column)), ignorenulls=True)

    wide = found.groupBy("row").agg(
        of(0, "id").alias("id"),
        of(0, "label").alias("label"),
        *[of(p, "entry").alias(f"e{p}") for p in range(PARTS)],
        *[of(p, "apart").alias(f"d{p}") for p in range(PARTS)],
    )
    error = F.col("d0")
    for p in range(1, PARTS):
        error = F.try_add(error, F.col(f"d{p}"))
    return wide.select(
        "row", "id", "label", F.array(*[f"e{p}" for p in range(PARTS)]).alias("codes"),
        error.alias("error"),
    )


def compress(
    vectors: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    rounds: int = ROUNDS,
) -> tuple[DataFrame, Books]:
    """Per kept vector: row, id, label, codes, error; and the final codebooks."""
    kind = vectors.schema[vector].dataType.elementType
    floats = isinstance(kind, (T.FloatType, T.DoubleType))
    content = F.col(vector) if floats else F.col(vector).cast("array<double>")
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(row_id).alias("id"),
        F.col(label).alias("label"),
        content.alias("vector"),
    ).where(finite(F.col("vector")))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    first = rows.orderBy(*order).select(F.size("vector")).first()
    if first is None:
        none = rows.select(
            "row", "id", "label", F.array().cast("array<int>").alias("codes"),
            F.lit(None).cast("long").alias("error"),
        )
        return none, [[] for _ in range(PARTS)]
    width = first[0]
    rows = rows.where(F.size("vector") == width)
    seeds = rows.orderBy(*order).limit(ENTRIES).select("vector").collect()
    table = np.array([r[0] for r in seeds], np.float64).reshape(len(seeds), width)
    bounds = part_bounds(width)
    books = [to_integers(table[:, a:b]).tolist() for a, b in zip(bounds, bounds[1:])]
    blocks = block_table(rows, table)
    books = trained(blocks, books, rounds)
    return assigned(blocks, books, rows.schema), books


def books_digest(books: Books) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    text = ",".join(str(v) for entries in books for e in entries for v in e)
    return hashlib.sha256(text.encode()).hexdigest()


def code_table(vectors: DataFrame) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    found, books = compress(vectors)
    named = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = written(found.withColumn("_label", named), "codes")
    whole = F.count("error") == F.count(F.lit(1))
    sums = written(
        coded.groupBy("_label").agg(
            F.when(whole, F.try_sum("error")).alias("label_error"),
            F.count(F.lit(1)).alias("_rows"),
        ),
        "label-errors",
    )
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return spread_join(coded, sums, "_label", "_rows", ["row"]).select(
        F.col("id").alias("vec_id"),
        code.alias("code"),
        "error",
        "label_error",
        F.lit(books_digest(books)).alias("codebooks_sha256"),
    )


def oracle() -> str:
    """The same in SQL: rounds written out, all points against all entries."""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT part, r, arg_min(e, (apart, e)) AS e, min(apart) AS apart FROM (
    SELECT part, r, e, sum((x - c) * (x - c)) AS apart
    FROM p JOIN b{k} USING (part, i) GROUP BY part, r, e)
  GROUP BY part, r)""")
        if k < ROUNDS:
            steps.append(f"""
m{k} AS (
  SELECT part, e, i, sum(x) AS s, count(*) AS n FROM p JOIN a{k} USING (part, r)
  GROUP BY part, e, i),
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.e, b.i, CAST(
    CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS c
  FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.e = m.e AND b.i = m.i)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, (i - 1) // (n // {PARTS}) AS part, (i - 1) % (n // {PARTS}) AS i, x FROM (
    SELECT r, unnest(x) AS x, unnest(range(1, len(x) + 1)) AS i, len(x) AS n FROM v)),
b0 AS (SELECT part, r AS e, i, x AS c FROM p WHERE r < {ENTRIES}),{",".join(steps)},
d AS (
  SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, e, i) AS text FROM b{ROUNDS}),
f AS (
  SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY part) AS code,
         CAST(sum(apart) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       sha256(text) AS codebooks_sha256
FROM v JOIN f USING (r), d
"""
