"""Substring dedup against a brute-force search of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from oracles import morse
from tickloom.llm import windows
from tickloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """Per row: words, how many go, the kept ones."""
    words = [WORD.findall(text or "") for _, text in rows]
    seen = Counter(
        tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1)
    )
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), kept))
    return sorted(out, key=str)


def found(frame):
    return sorted(
        (
            (r.doc_id, r.n_words, sum(r.removed[1::2]) - sum(r.removed[0::2]), r.kept)
            for r in frame.collect()
        ),
        key=str,
    )


def test_lengths():
    assert windows.lengths(35) == [9, 18, 35]
    assert windows.lengths(8) == [8]


def test_extreme():
    values = np.array([5, 3, 8, 1, 9, 2], np.uint64)
    for width in range(1, 7):
        want = [values[i : i + width].min() for i in range(len(values) - width + 1)]
        assert windows.extreme(values, width, np.minimum).tolist() == want


@pytest.mark.parametrize("window", [3, 13, 35])
def test_random_texts(spark, window):
    pick = random.Random(window)
    parts = [" ".join(pick.choice("abcdef") + str(pick.randrange(40)) for _ in range(n))
             for n in (2, 10, 30, 34, 35, 36, 50, 90)]
    rows = []
    for i in range(60):
        text = pick.choice([" ", "\n", "\t  "]).join(pick.choice(parts) for _ in range(pick.randrange(6)))
        rows.append((i, text + f" unique{i}"))
    rows += [(100 + i, rows[3][1]) for i in range(3)]  # copies
    rows += [(200, "x " * 300), (201, None), (201, ""), (None, parts[-1]), (202, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(windows.remove_repeats(docs, window=window)) == brute(rows, window)


def test_clashing_names_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 1, "k", True), (2, "a " + text, 2, "k", None)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, small long, kept string, witness boolean"
    )
    assert found(windows.remove_repeats(docs)) == [(1, 40, 40, ""), (2, 41, 40, "a")]
    assert found(windows.remove_repeats(docs.limit(0))) == []


def test_long_text(spark):
    body = " ".join(f"w{i}" for i in range(600_000))
    docs = spark.createDataFrame([(1, body), (2, "start " + body[:400])], "doc_id long, text string")
    same = body[:400].split()[:-1]  # the last word is cut
    got = found(windows.remove_repeats(docs))
    assert [(d, n, g) for d, n, g, _ in got] == [
        (1, 600_000, len(same)), (2, len(same) + 2, len(same))
    ] or [(d, n, g) for d, n, g, _ in got] == [
        (1, 600_000, len(same) + 1), (2, len(same) + 2, len(same) + 1)
    ]


def test_query(spark, sf_dir):
    rows = [
        (r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ]
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows, 35)]
    got = sorted((tuple(r) for r in QUERIES["op7_windows"](spark, sf_dir).collect()), key=str)
    assert got == sorted(want, key=str)


def test_words_of_a_regular_pattern_are_told_apart(spark):
    one, other = morse(10)
    common = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{common} {one}"), (2, f"{common} {other}"), (3, f"x {common}"), (4, f"x {common}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(windows.remove_repeats(docs)) == brute(rows, 35)
