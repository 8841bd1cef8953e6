"""The n-gram join against exact similarities of all pairs."""

import random
import re

import numpy as np
import pytest

from oracles import morse
from tickloom.llm import jaccard
from tickloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Per row (doc_id, class_id, n_links, n_copies) from all pairs with a common n-gram."""
    sets, at = [], {}
    for text in dict.fromkeys(t or "" for _, t in rows):
        w = WORD.findall(text)
        n = min(jaccard.NGRAM, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        at[text] = len(sets)
        sets.append(grams)
    texts = list(at)
    copies = [sum((t or "") == x for _, t in rows) for x in texts]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for h in holders.values() for x, a in enumerate(h) for b in h[x + 1 :]}
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(sets)
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= jaccard.PERCENT * (len(sets[a]) + len(sets[b]) - shared):
            links[a] += copies[b]
            links[b] += copies[a]
            root[find(a)] = find(b)
    ids = {}
    for d, t in rows:
        if d is not None and sets[at[t or ""]]:
            k = find(at[t or ""])
            ids[k] = min(ids.get(k, d), d)
    out = []
    for d, t in rows:
        i = at[t or ""]
        if sets[i]:
            out.append((d, ids.get(find(i)), links[i] + copies[i] - 1, copies[i]))
        else:
            out.append((d, d, 0, copies[i]))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def family(pick, size, words=120, changes=3):
    base = [f"w{pick.randrange(5000)}" for _ in range(words)]
    for _ in range(size):
        own = list(base)
        for _ in range(pick.randrange(changes + 1)):
            own[pick.randrange(words)] = f"x{pick.randrange(10**6)}"
        yield " ".join(own)


def test_bands():
    bands, rows = jaccard.band_counts(0.8, 0.9999, 256)
    assert bands * rows <= 256 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        jaccard.band_counts(0.1, 0.9999, 4)


def test_overlaps():
    random_sets = np.random.default_rng(1)
    sets = [np.unique(random_sets.integers(0, 9000, n)).astype(np.uint64) for n in (0, 1, 5000, 7000)]
    sets.append(sets[2])
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = jaccard.overlaps(sets)
    for i in range(len(sets)):
        for j in range(len(sets)):
            if i != j:
                assert got[i, j] == want[i][j]


def sample():
    pick = random.Random(5)
    rows = []
    for size in (1, 1, 2, 3, 8, 40):
        rows += [(len(rows) + k, t) for k, t in enumerate(family(pick, size))]
    rows += [(500 + i, rows[-1][1]) for i in range(4)]
    rows += [(600, None), (601, ""), (602, " \n"), (603, "one"), (604, "one"), (605, "one two")]
    rows += [(None, "one two"), (606, "one  two"), (607, rows[5][1].replace(" ", "\n"))]
    return rows


@pytest.mark.parametrize("block", [1000, 7])
def test_families(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(jaccard.classes(docs)) == brute(rows)


def test_keep_one(spark):
    rows = [(d, t, "s", d) for d, t in sample()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, label long")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    least = {d: c for d, c, _, _ in brute([r[:2] for r in rows])}
    texts = {d: t or "" for d, t, _, _ in rows}
    # Of each class the text of the least id stays, with all rows that have it.
    want = [d for d, t, _, _ in rows if texts[least[d] if d is not None else 605] == (t or "")]
    want += [d for d, t, _, _ in rows if not WORD.findall(t or "") and d not in want]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_components(spark):
    pick = random.Random(3)
    edges = [(i + 1, i) for i in range(40)] + [(100 + pick.randrange(60), 50 + pick.randrange(40))
                                              for _ in range(50)]
    frame = spark.createDataFrame(edges, "a long, b long")
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in jaccard.components(frame).collect()}
    assert got == label
    assert jaccard.components(frame.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [
        (r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ]
    assert found(QUERIES["op10_near"](spark, sf_dir)) == brute(rows)


def test_empty(spark):
    assert found(jaccard.classes(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_words_of_a_regular_pattern_are_told_apart(spark):
    for size in (5, 10, 13):
        one, other = morse(size)
        few = " ".join(one).replace("a", "yes").replace("b", "no")
        many = " ".join(other).replace("a", "yes").replace("b", "no")
        rows = [(1, one), (2, other), (3, few), (4, many)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert found(jaccard.classes(docs)) == brute(rows)


def test_very_long_texts(spark):
    base = [f"w{i % 7919}" for i in range(400_000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-9])), (3, "x" * 3_000_000), (4, "x" * 3_000_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard.classes(docs)) == brute(rows)
