"""Vector codes against a plain loop over all points and entries, in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tickloom.llm import vector_codes
from tickloom.llm.vector_codes import code_table


def brute(rows):
    """Rows (vec_id, vector, label) to the query's rows, sorted."""
    kept = [
        r for r in rows
        if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return []
    n = len(kept[0][1])
    cuts = [n * k // 4 for k in range(5)]

    def whole(x):
        top, bottom = float(x).as_integer_ratio()
        return top * 1024 // bottom

    points = [[[whole(x) for x in v[a:b]] for a, b in zip(cuts, cuts[1:])] for _, v, _ in kept]
    books = [[p[k] for p in points[:256]] for k in range(4)]

    def nearest():
        return [
            [
                min((sum((x - c) ** 2 for x, c in zip(p[k], e)), i) for i, e in enumerate(books[k]))
                for k in range(4)
            ]
            for p in points
        ]

    for _ in range(4):
        found = nearest()
        for k in range(4):
            for i in range(len(books[k])):
                own = [p[k] for p, f in zip(points, found) if f[k][1] == i]
                if own:
                    books[k][i] = [sum(c) // len(own) for c in zip(*own)]
    found = nearest()
    digest = hashlib.sha256(
        ",".join(str(x) for book in books for e in book for x in e).encode()
    ).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, label), e in zip(kept, errors):
        labels[label] = labels.get(label, 0) + e

    def long(x):
        return x if x < 1 << 63 else None

    def total(label):
        own = [e for (_, _, x), e in zip(kept, errors) if x == label]
        return long(sum(own)) if all(e < 1 << 63 for e in own) else None

    return sorted(
        ((i, "".join(f"{c:02x}" for _, c in f), long(e), total(label), digest)
         for (i, _, label), f, e in zip(kept, found, errors)),
        key=str,
    )


def found(spark, rows, kind="array<float>"):
    schema = f"part string, vec_id long, embedding {kind}, row string, label int, curve int"
    frame = spark.createDataFrame([("x", i, v, "y", label, 1) for i, v, label in rows], schema)
    out = code_table(frame.repartition(3))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def vectors(pick, n, width, labels=(0, 1, 2, None)):
    heads = [[pick.gauss(0, 0.3) for _ in range(width)] for _ in range(7)]
    out = []
    for i in range(n):
        head = pick.choice(heads)
        v = [float(np.float32(x + pick.gauss(0, 0.05))) for x in head]
        out.append((i * 3 % n, v, pick.choice(labels)))
    return out


@pytest.mark.parametrize("block", [128, 5])
def test_codes(spark, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rows = vectors(random.Random(block), 400, 16)
    # A vector that a third of all rows share, repeated rows, and rows to be dropped.
    rows += [(1000 + i, rows[7][1], 1) for i in range(200)] + rows[:3]
    rows += [(None, rows[0][1], 0), (None, rows[1][1], None), (5, None, 1)]
    rows += [(6, [*rows[0][1][:-1], x], 1) for x in (None, math.nan, math.inf, -math.inf)]
    rows += [(2000, rows[0][1][:-1], 1), (2001, [], 1)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("width", [0, 1, 6, 64])
def test_widths(spark, width):
    rows = vectors(random.Random(width), 60, width)
    assert found(spark, rows) == brute(rows)


def test_large_values(spark):
    pick = random.Random(4)
    rows = vectors(pick, 300, 8)
    scales = [1.0, 1e4, 1e7, 1e15, 1e38, 1e300]
    rows = [(i, [x * pick.choice(scales) for x in v], label) for i, v, label in rows]
    assert found(spark, rows, "array<double>") == brute(rows)
    ints = [(i, [pick.randrange(-9, 9) for _ in range(8)], 1) for i in range(40)]
    assert found(spark, ints, "array<int>") == brute(ints)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [float(i % 3)] * 4, 0) for i in range(30)]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == [] == found(spark, [(1, None, 1), (2, [math.nan], 2)])


def test_hilbert_curve_visits_neighbours():
    for bits, axes in ((1, 3), (2, 2), (4, 2), (3, 3)):
        grid = np.array(list(np.ndindex(*[1 << bits] * axes)))
        place = vector_codes.hilbert(grid, bits)
        assert sorted(place.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_limbs():
    for values in ([5, -7, 0], [1 << 61, -(1 << 61)], [1 << 100, -(1 << 99), 3]):
        wide = np.empty(len(values), object)
        wide[:] = values
        rows = vector_codes.limbs(wide)
        got = [sum(int(x) << (31 * k) for k, x in enumerate(column)) for column in rows.T]
        assert got == values


def test_shortlists_keep_the_nearest():
    rng = np.random.default_rng(3)
    points = rng.integers(-50, 50, (30, 1, 4)) + rng.integers(-9, 9, (30, 20, 4))
    entries = rng.integers(-80, 80, (40, 4))
    kept = vector_codes.shortlists(points.min(axis=1), points.max(axis=1), entries)
    assert not kept.all()
    for block, short in zip(points, kept):
        apart = vector_codes.distances(block, entries)
        assert short[(apart == apart.min(axis=1)[:, None]).any(axis=0)].all()
