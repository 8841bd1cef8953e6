"""HyperMinHash near duplicates against exact similarities of all pairs."""

import random

import numpy as np
import pytest

from oracles import WORD, morse
from tickloom.llm import hyper_minhash as h
from tickloom.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    n = min(3, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute(rows):
    """Per row (doc_id, n_shingles, component_id, kept) from all pairs with a common shingle."""
    own = [shingle_set(t) for _, t in rows]
    sets = list(dict.fromkeys(s for s in own if s))
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for x in holders.values() for k, a in enumerate(x) for b in x[k + 1 :]}
    for a, b in pairs:
        a, b = sets[a], sets[b]
        shared = len(a & b)
        if 100 * shared >= 85 * (len(a) + len(b) - shared):
            root[find(a)] = find(b)
    least = {}
    for (d, _), s in zip(rows, own):
        if s and d is not None:
            least[find(root_of(root, s))] = min(d, least.get(find(root_of(root, s)), d))
    out = []
    for (d, _), s in zip(rows, own):
        component = least.get(find(root_of(root, s))) if s else d
        out.append((d, len(s), component, d == component))
    return sorted(out, key=str)


def root_of(root, s):
    return next(iter({root[s]}))


def found(spark, rows, parts=4):
    frame = spark.createDataFrame(
        [(d, "k", t, 1, "s") for d, t in rows], "doc_id long, key string, text string, n int, sketch string"
    )
    out = h.near_duplicates(frame.repartition(parts))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def family(pick, size, words, changes):
    base = [f"w{pick.randrange(5000)}" for _ in range(words)]
    for _ in range(size):
        own = list(base)
        for _ in range(pick.randrange(changes + 1)):
            own[pick.randrange(words)] = f"x{pick.randrange(10**6)}"
        yield " ".join(own)


def sample():
    pick = random.Random(5)
    rows = []
    # Near copies around the threshold, from short texts to long ones, and a hot phrase.
    for size, words, changes in ((40, 9, 1), (40, 30, 2), (60, 120, 6), (30, 900, 40), (1, 50, 0)):
        rows += [(len(rows) + k, t) for k, t in enumerate(family(pick, size, words, changes))]
    rows += [(1000 + i, f"all rights reserved {pick.choice('abcdef')} {pick.choice('abc')}") for i in range(40)]
    rows += [(2000 + i, rows[70][1]) for i in range(50)]
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "One"), (3004, "one"), (3005, "one two")]
    rows += [(None, "one two"), (3006, "ONE  two"), (3007, rows[5][1].replace(" ", "\n").upper())]
    rows += [(None, "alone here"), (None, None), (7, "x y z"), (7, "p q r"), (7, "p q r")]
    return rows + [(4000 + i, w) for i, w in enumerate(morse(10))]


@pytest.mark.parametrize("blocks", [None, 7])
@pytest.mark.parametrize("stars", [False, True])
def test_families(spark, monkeypatch, blocks, stars):
    monkeypatch.setattr(h, "STARS", stars)
    if blocks:
        monkeypatch.setattr(h, "BLOCK_ROWS", blocks)
        monkeypatch.setattr(h, "BLOCK_REGISTERS", blocks)
    assert found(spark, sample()) == brute(sample())


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_near_sets"](spark, sf_dir).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert found(spark, [], 1) == []
    assert found(spark, [(1, None), (2, "")], 1) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_very_long_texts(spark):
    base = [f"w{i % 7919}" for i in range(300_000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-9])), (3, "x" * 3_000_000), (4, "x" * 3_000_001)]
    assert found(spark, rows, 1) == brute(rows)


def elements(rng, n):
    return np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))


def test_registers_keep_the_order_of_values():
    rng = np.random.default_rng(1)
    own = elements(rng, 3000)
    whole = h.registers(own)
    assert len(whole) == h.SIZE and (whole != h.EMPTY).all()
    # The least of two sets' values is the least of their union's.
    a, b = h.registers(own[:1000]), h.registers(own[1000:])
    assert ((whole == a) | (whole == b)).all()
    both = (a != h.EMPTY) & (b != h.EMPTY)
    zeros = np.stack([whole, a, b])[:, both].astype(int) >> h.MANTISSA
    assert both.any() and (zeros[0] == zeros[1:].max(axis=0)).all()
    few = h.registers(own[:3])
    assert (few != h.EMPTY).sum() <= 3 and set(h.filled(few)) == set(few[few != h.EMPTY])
    assert (h.registers(own[:0]) == h.EMPTY).all()


def test_estimates():
    rng = np.random.default_rng(2)
    common = elements(rng, 20_000)
    for share in (0.3, 0.6, 0.85):
        n = 4000
        k = int(2 * n * share / (1 + share))
        a = np.concatenate([common[:k], elements(rng, n - k)])
        b = np.concatenate([common[:k], elements(rng, n - k)])
        x, y = h.registers(a), h.registers(b)
        agree, either = (x == y).sum(), np.int64(h.SIZE)
        chance = (h.level_shares(np.array([n])) * h.level_shares(np.array([n]))).sum() / 1024
        assert 0 < chance < 0.01
        assert abs((agree / either - chance) / (1 - chance) - share) < 0.15
        assert bool(h.ruled_out(agree, either, chance)) == (share < 0.7)
    assert h.level_shares(np.array([1, 500, 10**6])).sum(axis=1) == pytest.approx(1)


def test_pairs_at_the_threshold_are_found():
    """Pairs of sets of a similarity just above the threshold share a band, large or small."""
    rng = np.random.default_rng(3)
    for n in (7, 12, 40, 200, 1500):
        missed = 0
        for _ in range(300):
            pool = elements(rng, n)
            gone = int(0.15 * len(pool))
            a, b = pool[: len(pool) - gone // 2], pool[gone - gone // 2 :]
            a, b = h.registers(a), h.registers(b)
            missed += not (h.band_hashes(a) == h.band_hashes(b)).any()
        assert missed == 0


def test_shared_counts_and_forest():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9000, n)).astype(np.uint64) for n in (1, 5000, 7000, 3)]
    want = [[len(np.intersect1d(a, b)) for b in sets[1:]] for a in sets[:3]]
    assert h.shared_counts(sets[:3], sets[1:]).tolist() == want
    linked = np.array([[1, 0, 0], [1, 1, 0], [0, 0, 1]], bool)
    high, low = h.forest(linked, np.array([9, 5, 1]), np.array([7, 6, 2]))
    assert sorted(zip(high, low)) == [(2, 1), (6, 5), (7, 5), (9, 5)]
