"""Collocations against plain counters."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tickloom.llm import collocations as c

SPLIT = re.compile(r"[.,;:!?\x0A-\x0D]")
WORD = re.compile(r"[^\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=2000):
    """Rows (lang, text) to the query's rows."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in SPLIT.split((text or "").translate(LOWER)):
            w = WORD.findall(piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        found = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= 10}
        for p, a in candidates.items():
            cuts = []
            for k in range(1, len(p)):
                left, right = counts[p[:k]], counts[p[k:]]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            longer = [
                b for q, b in candidates.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            ]
            if all(100 * b < 50 * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(spark, rows, top=2000):
    frame = spark.createDataFrame(
        [(lang, "p", text, 1, "k") for lang, text in rows],
        "lang string, phrase string, text string, n int, key string",
    )
    out = c.collocations(frame.repartition(3), top=top)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def sample(seed=1):
    pick = random.Random(seed)
    words = [*"abcdefgh", "Äa", "X", "x", "\0", "w\x1c", "語", "..."]
    phrases = ["new york city", "a b c", "hot dog", "Hot  dog", "to be\tor not", "a a a a", "x\ny z"]
    rows = []
    for _ in range(120):
        parts = [
            pick.choice(phrases) if pick.random() < 0.3 else pick.choice(words)
            for _ in range(pick.randrange(40))
        ]
        joined = "".join(p + pick.choice([" ", " ", " ", "  ", "\t", ". ", "\r\n", ","]) for p in parts)
        rows.append((pick.choice(["en", "en", "de", None, "und", ""]), joined))
    return rows + [("en", None), (None, None), ("fr", ""), ("fr", " .\n, "), ("it", "just one")] + rows[:9]


@pytest.mark.parametrize("pack", [1 << 21, 300, 7])
def test_counts(spark, monkeypatch, pack):
    monkeypatch.setattr(c, "PACK", pack)
    monkeypatch.setattr(c, "BUCKET", 300)
    assert found(spark, sample()) == brute(sample())


def test_top_and_ties(spark):
    assert found(spark, sample(2), 3) == brute(sample(2), 3)


def test_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(c, "_PRIMES", ((3, 2), (5, 2)))
    monkeypatch.setattr(c, "_tables", {})
    body = c.normal("b a. a b. ab")
    prints, starts, _ = c.grams(body, len(body), 1, 1)
    assert len(set(prints.tolist())) < len(prints) == 7


def test_whole_results_survive_collisions(spark, monkeypatch):
    plain = c.grams

    def colliding(body, own, seed, bits):
        prints, starts, ends = plain(body, own, seed, bits)
        return prints & ~np.uint64(0xFFFFFFFFFFF0), starts, ends

    packs = c.pack_table(spark.createDataFrame(sample(), "lang string, text string"), "text", "lang")
    monkeypatch.setattr(c, "grams", colliding)
    rows = c.frequent_phrases(packs, 5000)
    got = {(r.lang, r.phrase): r.f for r in rows.collect()}
    want = defaultdict(int)
    for lang, text in sample():
        for piece in SPLIT.split((text or "").translate(LOWER)):
            w = WORD.findall(piece)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    want["und" if lang is None else lang, " ".join(w[i : i + size])] += 1
    assert got == {k: f for k, f in want.items() if f >= 10}


def test_very_long_words_and_texts(spark, monkeypatch):
    monkeypatch.setattr(c, "PACK", 5_000)
    long_word = "w" * 600_000
    rows = [("en", f"{long_word} end {'tick tock ' * 2000}") for _ in range(10)]
    assert found(spark, rows) == brute(rows)


def test_segments_keep_every_gram():
    pick = random.Random(3)
    body = c.normal("".join(pick.choice("ab . ") for _ in range(2000)))
    for size in (1, 10, 100, 5000):
        counts, words = Counter(), 0
        for part, own in c.segments(body, size):
            words += c.word_number(part, own)
            for n, s, e in zip(*c.grams(part, own, 0, 4)):
                counts[part[s:e]] += 1
        want = Counter()
        for piece in body.split(b"\n"):
            w = piece.split(b" ")
            for n in (1, 2, 3):
                want.update(b" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
        assert counts == want
        assert words == sum(f for p, f in want.items() if b" " not in p)


def test_large_counts_are_exact(spark):
    rows = [("en", w, n, f) for w, n, f in (
        ("a b", 2, 2_999_999_999_999), ("a", 1, 3_000_000_000_001), ("b", 1, 2_999_999_999_999),
        ("b c", 2, 10**14), ("c", 1, 10**15))]
    rows[2] = ("en", "b", 1, 10**14 + 7)
    frame = spark.createDataFrame(rows, "lang string, phrase string, n_words int, f long")
    got = {r.phrase: (r.l, r.r, r.score) for r in c.scored(frame).collect()}
    f = {p: x for _, p, _, x in rows}
    for p in ("a b", "b c"):
        x, y = p.split()
        assert got[p] == (f[x], f[y], 10**6 * f[p] ** 2 // (f[x] * f[y]))


def test_empty(spark):
    assert found(spark, []) == [] == found(spark, [(None, None), ("en", "one two")])
