"""Line dedup against a plain search for earlier runs."""

import random
import re

import pytest

from tickloom.llm import line_runs
from tickloom.llm.support import written
from tickloom.operators import ordered


def brute(rows, least):
    """Per distinct (id, text): lines, removed lines, longest shared run, kept text."""
    docs = []
    for doc, text in rows:
        if (doc, text or "") not in docs:
            docs.append((doc, text or ""))
    docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
    suffixes = []
    for n, (_, text) in enumerate(docs):
        worded = [(i, x) for i, x in enumerate(text.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
        suffixes += [(n, worded[k:]) for k in range(len(worded))]
    removed = [set() for _ in docs]
    longest = [0] * len(docs)
    runs = [[x for _, x in s] for _, s in suffixes]
    for i, (n, _) in enumerate(suffixes):
        for j, other in enumerate(runs):
            if i != j:
                same = next((k for k, (x, y) in enumerate(zip(runs[i], other)) if x != y),
                            min(len(runs[i]), len(other)))
                longest[n] = max(longest[n], same)
    first = set()
    for n, s in suffixes:
        if len(s) >= least:
            run = tuple(x for _, x in s[:least])
            if run in first:
                removed[n].update(i for i, _ in s[:least])
            first.add(run)
    out = {}
    for n, (doc, text) in enumerate(docs):
        lines = text.split("\n")
        kept = "\n".join(x for i, x in enumerate(lines) if i not in removed[n])
        out[doc, text] = (len(lines), sorted(removed[n]), longest[n], kept)
    return sorted(((d, *out[d, t or ""]) for d, t in rows), key=str)


def found(frame):
    return sorted(((r.doc_id, r.n_lines, r.removed, r.longest, r.kept) for r in frame.collect()), key=str)


@pytest.mark.parametrize("least", [1, 2, 3, 4])
def test_random_texts(spark, least):
    pick = random.Random(least)
    parts = ["\n".join(f"l{pick.randrange(30)}" for _ in range(n)) for n in (1, 2, 3, 5, 9, 17)]
    rows = []
    for i in range(40):
        blocks = [pick.choice([*parts, "", " \t", f"own {i}"]) for _ in range(pick.randrange(6))]
        rows.append((i, "\n".join(blocks)))
    rows += [(50, rows[7][1]), (51, rows[7][1]), (51, rows[7][1]), (52, None), (53, "")]
    rows += [(54, "same\n" * 9 + "same"), (None, parts[-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(line_runs.remove_copies(docs, least=least)) == brute(rows, least)


def test_edges(spark):
    rows = [(1, "a\nb", 1), (2, "x\na\nb\ny", 2), (3, "z" * 300_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sid long")
    for least in (1, 2):
        got = found(line_runs.remove_copies(docs, least=least))
        assert [(d, r) for d, _, r, _, _ in got] == [(1, []), (2, [1, 2]), (3, [])]
    assert found(line_runs.remove_copies(docs.limit(0))) == []
    alone = spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string")
    assert found(line_runs.remove_copies(alone)) == [(1, 3, [], 0, "a\nb\nc")]


def test_a_line_that_two_places_go_on_from_differently(spark):
    rows = [(1, "b\nx\nc"), (2, "a\nx\nd"), (3, "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(d, r, n) for d, _, r, n, _ in found(line_runs.remove_copies(docs))]
    assert got == [(1, [], 1), (2, [1], 1), (3, [], 0)]


def test_single_lines_go_too(spark):
    rows = [(1, "Accept cookies"), (2, "Accept cookies"), (3, "a\nAccept cookies\n\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(d, r, n) for d, _, r, n, _ in found(line_runs.remove_copies(docs))]
    assert got == [(1, [], 1), (2, [0], 1), (3, [1], 1)]


@pytest.mark.parametrize("rows_of_a_slice", [10, 1 << 20])
def test_maximal_runs(spark, monkeypatch, rows_of_a_slice):
    monkeypatch.setattr(ordered, "SLICE_ROWS", rows_of_a_slice)
    pick = random.Random(9)
    texts = ["\n".join(pick.choice("abc") for _ in range(pick.randrange(1, 14))) for _ in range(25)]
    texts += ["x\ny\nz", "q\nx\ny\nz\nx\ny", "only"]
    docs = list(dict.fromkeys((i, t) for i, t in enumerate(texts)))
    runs = [(i, k, t.split("\n")[k:]) for i, t in docs for k in range(t.count("\n") + 1)]

    def same(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    shared = {
        (i, k): max(same(s, o) for j, m, o in runs if (j, m) != (i, k)) for i, k, s in runs
    }
    want = sorted(
        (i, k, n) for (i, k), n in shared.items() if n and shared.get((i, k - 1), 0) <= n
    )
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in line_runs.maximal_runs(frame).collect()) == want


def test_a_round_is_one_table(spark, monkeypatch):
    tables = []

    def counted(frame, purpose):
        tables.append(purpose)
        return written(frame, purpose)

    monkeypatch.setattr(line_runs, "written", counted)
    text = "\n".join(f"l{i}" for i in range(20))
    rows = [(1, text), (2, text), (3, "l3\nl4\nother")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(line_runs.remove_copies(docs)) == brute(rows, 1)
    # Rounds for 1, 2, 4, 8 and 16 lines, and the places before the first one.
    assert tables.count("places") == 6 and not {"active", "parts", "ranks"} & set(tables)


@pytest.mark.parametrize("rows_of_a_slice", [2, 5])
def test_classes_of_any_size(spark, monkeypatch, rows_of_a_slice):
    monkeypatch.setattr(ordered, "SLICE_ROWS", rows_of_a_slice)
    pick = random.Random(3)
    rows = [(i, "\n".join(pick.choice("ab") for _ in range(pick.randrange(1, 12)))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(line_runs.remove_copies(docs)) == brute(rows, 1)
