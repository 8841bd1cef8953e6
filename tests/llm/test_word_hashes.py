"""Word and run hashes: equal for equal words only, whatever lies around them."""

import random

import numpy as np
import pyarrow as pa

from oracles import WORD, morse
from tickloom.llm.word_hashes import batches_of_words, run_hashes


def hashes(texts):
    out = []
    for _, found, at in batches_of_words(pa.array(texts, pa.string())):
        out += [found[at[k] : at[k + 1]] for k in range(len(at) - 1)]
    return out


def test_hashes_stand_for_words():
    pick = random.Random(2)
    words = ["", *morse(3), *morse(7), *morse(11), "a", "a\0", "a\0\0", "\0", "ab" * 300, "x" * 5000]
    words += ["".join(pick.choice("ab\0ä語") for _ in range(pick.choice((1, 7, 8, 9, 16, 600))))
              for _ in range(200)]
    texts = [pick.choice(" \t\n").join(pick.choices(words, k=9)) for _ in range(300)]
    known = {}
    for text, found in zip(texts, hashes(texts)):
        own = WORD.findall(text)
        assert len(own) == len(found)
        for word, h in zip(own, found.tolist()):
            assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_runs():
    values = np.array([random.Random(1).getrandbits(64)] * 20 + list(range(40)), np.uint64)
    for length in (1, 2, 3, 5, 8, 13, 35, 60, 61):
        runs = run_hashes(values, length)
        want = [tuple(values[i : i + length]) for i in range(len(values) - length + 1)]
        assert len(runs) == len(want)
        assert len(set(zip(want, runs.tolist()))) == len(set(want)) == len(set(runs.tolist()))
