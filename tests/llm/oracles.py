"""Brute-force versions of operators, written without the operators' code."""

import math
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\W_]+|(?:[^\w\x20\x09-\x0D]|_)+")


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    covered = set()
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 8))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def signed_hash(text, seed=42):
    h = xxhash.xxh64_intdigest(text.encode(), seed=seed)
    return h - (1 << 64) if h >> 63 else h


def grams(text):
    t = TOKEN.findall(text or "")
    return [signed_hash(g) % (1 << 14) for g in t + [f"{a} {b}" for a, b in zip(t, t[1:])]]


def quality(docs, trusted):
    """Per document the log ratio, or None, from plain counters."""
    size, smoothing = 1 << 14, 0.05
    raw, target = Counter(), Counter()
    own = [grams(text) for _, text in docs]
    for (doc, _), g in zip(docs, own):
        raw.update(g)
        if doc in trusted:
            target.update(g)
    all_raw, all_target = sum(raw.values()), sum(target.values())
    weight = all_target * smoothing + 1

    def ratio(b):
        p = (raw[b] + 1) / (all_raw + size)
        return math.log((target[b] + weight * p) / (all_target + weight) / p)

    return [sum(map(ratio, g)) / len(g) if g else None for g in own]


def targets(sizes, weights, share, epochs):
    """Targets by giving out the excess again and again. ``sizes`` in the order of sources."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    caps = [epochs * s for s in sizes]
    budget, capped = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = budget - sum(caps[i] for i in capped)
        scale = left / sum(weight[i] for i in free) if free else 0
        over = [i for i in free if weight[i] * scale > caps[i]]
        if not over:
            return [caps[i] if i in capped else weight[i] * scale for i in range(len(sizes))]
        capped.update(over)


def best_sum(lengths, budget):
    """The largest sum of some of the lengths that is not above the budget."""
    reached = 1
    for x in lengths:
        reached |= reached << x
    reached &= (1 << (budget + 1)) - 1
    return reached.bit_length() - 1


def morse(size):
    """Two words of 2^size letters that polynomials modulo a power of two cannot tell apart."""
    word = "a"
    for _ in range(size):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))
