"""Source mixing: targets, exact fit, limits, and the same choice in every run."""

import random
from collections import Counter, defaultdict

import pytest
from oracles import WORD, best_sum, targets

from tickloom.llm import mixing
from tickloom.llm.queries import QUERIES


def check(rows, got, exact=True):
    """Rows (doc_id, text, source) against the table of the mix."""
    sizes = Counter()
    lengths = defaultdict(list)
    for _, text, source in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        lengths[source].append(n)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    order += [None] if None in sizes else []
    goals = targets([sizes[s] for s in order], (3, 1, 2), 1.5, 2)
    source = {d: s for d, _, s in rows}
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(goals[order.index(s)])
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    for s, goal in zip(order, goals):
        if not sizes[s]:
            continue
        whole, rest = divmod(goal, sizes[s])
        fit = int(whole) * sizes[s]
        if exact:
            fit += best_sum(lengths[s], round(rest))
            assert taken[s] == fit
        assert abs(taken[s] - goal) <= max(lengths[s])


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = QUERIES["op1_mix"](spark, sf_dir).collect()
    check([(r.doc_id, r.text, r.source) for r in docs], got, exact=False)
    for r in got:
        assert r.size == len(WORD.findall(next(d.text for d in docs if d.doc_id == r.doc_id)))


def test_small_sources_fit_exactly(spark):
    pick = random.Random(2)
    rows = [(i, "w " * pick.randrange(40), pick.choice("abcdé")) for i in range(300)]
    rows += [(400 + i, "w " * 9, None) for i in range(5)] + [(500, None, "z"), (501, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(rows, mixing.mix_table(docs).collect())


def test_reruns_and_settings_agree(spark):
    rows = [(i, "w " * (i % 7), "ab"[i % 2]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = {r.doc_id: r.taken for r in mixing.mix_table(docs).collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = {r.doc_id: r.taken for r in mixing.mix_table(docs.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == again


def test_mixed_rows(spark):
    rows = [(i, "w " * (i % 5 + 1), "ab"[i % 2], i) for i in range(100)]
    rows += [(1, "w w", "a", 7)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    times = Counter(tuple(r) for r in mixed.collect())
    taken = sum(r.taken for r in mixing.mix_table(docs).collect())
    assert sum(len(r[1].split()) * n for r, n in times.items()) == taken
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_fill():
    assert mixing.fill([7, 5, 3], [2, 2, 2], 11) == [1, 0, 1] or sum(
        n * x for n, x in zip(mixing.fill([7, 5, 3], [2, 2, 2], 11), (7, 5, 3))
    ) == 11
    pick = random.Random(1)
    for _ in range(200):
        lengths = sorted({pick.randrange(1, 60) for _ in range(6)}, reverse=True)
        spare = [pick.randrange(4) for _ in lengths]
        budget = pick.randrange(300)
        got = mixing.fill(lengths, spare, budget)
        assert all(0 <= g <= s for g, s in zip(got, spare))
        items = [x for x, s in zip(lengths, spare) for _ in range(s)]
        assert sum(g * x for g, x in zip(got, lengths)) == best_sum(items, budget)
    # A budget far above the table is filled with whole lengths first.
    lengths = list(range(5000, 0, -1))
    got = mixing.fill(lengths, [50] * 5000, 123_456_789)
    assert sum(g * x for g, x in zip(got, lengths)) == 123_456_789


def test_rare_lengths_share_a_large_rest():
    # One document of each length: half of the source is more than the table holds.
    lengths = list(range(650, 0, -1))
    size = sum(lengths)
    got = mixing.fit(lengths, [1] * 650, size // 2, size)
    assert sum(g * x for g, x in zip(got, lengths)) == size // 2
    short = sum(g * x for g, x in zip(got, lengths) if x <= 325)
    assert short >= 0.25 * sum(range(326))


@pytest.mark.parametrize("most", [300, 900])
def test_one_document_of_each_length_gives_even_bands(most):
    """Some 45,000 and 400,000 words: every band of lengths gives about its half."""
    lengths = list(range(most, 0, -1))
    size = sum(lengths)
    shares = []
    for seed in range(8):
        got = mixing.fit(lengths, [1] * most, size // 2, size, f"{seed}")
        assert sum(g * x for g, x in zip(got, lengths)) == size // 2
        bands = [got[k * most // 5 : (k + 1) * most // 5] for k in range(5)]
        shares.append([sum(b) / len(b) for b in bands])
    for band in zip(*shares):
        assert 0.35 < sum(band) / len(band) < 0.65


def test_very_long_texts(spark):
    rows = [(1, "w " * 300_000, "a"), (2, "w " * 100_001, "a"), (3, "w" * 2_000_000, "a"), (4, "w " * 7, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check(rows, mixing.mix_table(docs).collect())
