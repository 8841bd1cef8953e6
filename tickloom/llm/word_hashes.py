"""Vectorised hashes of words and of runs of words, inside tasks.

Words are runs of bytes other than ASCII white space. A word is read in pieces of eight
bytes; its length and its pieces are mixed into 64 bits one after the other. A run of words
is mixed from the hashes of its halves. Mixing is not linear, so no pattern of letters or
words makes two different ones equal, as one does with polynomials modulo a power of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text handled at once.
CHUNK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Keeps the first 0 to 8 bytes of a piece.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# Longer words are mixed in rounds of this many pieces, so that one long word does not
# take a numpy call per piece.
_PIECES = 64


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two things one after the other, from theirs."""
    return mix(mix(left + _ODD) ^ right)


def _tree(pieces: np.ndarray) -> np.uint64:
    """One hash of many: neighbours are joined until one is left."""
    number = np.uint64(len(pieces))
    while len(pieces) > 1:
        if len(pieces) % 2:
            pieces = np.append(pieces, number)
        pieces = join(pieces[0::2], pieces[1::2])
    return pieces[0]


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range of bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # The eight bytes from every place on.
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    out = mix(length.astype(np.uint64) * _ODD + np.uint64(1))
    active = np.flatnonzero(length > 0)
    for k in range(_PIECES):
        left = length[active] - 8 * k
        active, left = active[left > 0], left[left > 0]
        if not len(active):
            return out
        piece = eight[starts[active] + 8 * k] & _KEEP[np.minimum(left, 8)]
        out[active] = join(out[active], piece)
    for i in active[length[active] > 8 * _PIECES]:
        places = np.arange(starts[i] + 8 * _PIECES, ends[i], 8)
        pieces = eight[places]
        pieces[-1] &= _KEEP[min(ends[i] - places[-1], 8)]
        numbers = np.arange(len(pieces), dtype=np.uint64)
        out[i] = join(out[i : i + 1], np.array([_tree(join(numbers, pieces))]))[0]
    return out


def _chunk_words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in some bytes, and where they start; a text begins at begins."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[begins] = True
    cut[0] = cut[-1] = True
    start = ~space
    start[1:] &= space[:-1] | cut[1:-1]
    end = ~space
    end[:-1] &= space[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return byte_hashes(data, starts, ends), starts


def _long_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of one long text, piece by piece."""
    parts, at = [], 0
    while at < len(data):
        stop = min(at + CHUNK, len(data))
        while stop < len(data) and not _SPACE[data[stop]]:
            more = np.flatnonzero(_SPACE[data[stop : stop + CHUNK]])
            stop = stop + int(more[0]) if len(more) else min(stop + CHUNK, len(data))
        parts.append(_chunk_words(data[at:stop], np.zeros(1, np.int64))[0])
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def batches_of_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Word hashes of texts without null: (number of the first text, hashes, offsets).

    The words of the k-th text of a batch are ``hashes[offsets[k]:offsets[k + 1]]``.
    """
    wide = texts.cast(pa.large_binary())
    _, offset_buffer, bytes_buffer = wide.buffers()
    at = np.frombuffer(offset_buffer, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(bytes_buffer, np.uint8) if bytes_buffer else np.zeros(0, np.uint8)
    first = 0
    while first < len(wide):
        behind = int(np.searchsorted(at, at[first] + CHUNK, side="right")) - 1
        behind = min(max(behind, first + 1), len(wide))
        own = at[first : behind + 1] - at[first]
        chunk = data[at[first] : at[behind]]
        if behind == first + 1 and len(chunk) > CHUNK:
            hashes = _long_words(chunk)
            offsets = np.array([0, len(hashes)])
        else:
            hashes, starts = _chunk_words(chunk, own[:-1])
            offsets = np.searchsorted(starts, own)
        yield first, hashes, offsets
        first = behind


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each word on, as far as there are so many.

    Runs whose length is a power of two are joined from their halves, others from a run
    of the power below at both ends.
    """
    size, runs = 1, hashes
    while 2 * size <= length:
        runs = join(runs[: max(0, len(runs) - size)], runs[size:])
        size *= 2
    rest = length - size
    return join(runs[: max(0, len(runs) - rest)], runs[rest:]) if rest else runs
