"""Byte-level BPE encoding and decoding with the ranks of a vocabulary file.

Pre-tokens are located without a regular expression. Every code point becomes a symbol
from its Unicode class and its next two neighbours; a symbol is a function from states to
states, and as functions compose associatively, a text is cut into blocks whose functions
are computed side by side, combined, and then replayed from the now known states. A table
says which (state, symbol) starts a pre-token. The slices between starts are merged by
rank, with a bounded cache of slices seen before.

The result is that of the usual pattern of this vocabulary: contractions, runs of letters,
of digits and of other signs with one leading space each, and white space, of which the
last sign before a word stands apart.

Null text counts as empty and has no ids. Long texts are scanned in pieces with the state
carried over. Texts are independent, so equal rows get equal results; there is no shuffle. An
empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.support import whole

# Classes of code points, and the symbols made of them. RUN is white space with more white
# space or the end behind it; BLANK and SPACE are the last of a run: U+0020 and any other.
# SHORT and LONG are apostrophes of contractions with one and two letters.
LETTER, DIGIT, SIGN, RUN, BLANK, SPACE, SHORT, LONG = range(8)
SYMBOLS = 8
# States after a code point. FRESH: whatever comes next starts a pre-token.
FRESH, IN_LETTERS, IN_DIGITS, IN_SIGNS, IN_RUN, AFTER_BLANK, ONE_MORE, TWO_MORE = range(8)
STATES = 8
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
         0x202F, 0x205F, 0x3000]  # fixed values: the White_Space property

# Code points scanned at once, and the length of a block.
CHUNK, BLOCK = 1 << 20, 1 << 10
# Slices kept per task, and the longest of them in characters.
CACHED, CACHED_LENGTH = 400_000, 64
# Longer slices are merged with a heap.
HEAP_FROM = 100


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token starts at this symbol."""
    if state in (ONE_MORE, TWO_MORE):
        return (FRESH if state == ONE_MORE else ONE_MORE), False
    if symbol in (SHORT, LONG):
        if state in (IN_SIGNS, AFTER_BLANK):
            return IN_SIGNS, False
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol == BLANK:
        return AFTER_BLANK, True
    if symbol == SPACE:
        return FRESH, True
    own = {LETTER: IN_LETTERS, DIGIT: IN_DIGITS, SIGN: IN_SIGNS, RUN: IN_RUN}[symbol]
    return own, not (state == own or (state == AFTER_BLANK and symbol != RUN))


def transition_tables() -> tuple[np.ndarray, np.ndarray]:
    """NEXT and START by symbol * STATES + state; symbols from SYMBOLS on begin a text."""
    following = np.zeros(2 * SYMBOLS * STATES, np.uint8)
    starts = np.zeros(2 * SYMBOLS * STATES, bool)
    for symbol in range(2 * SYMBOLS):
        for state in range(STATES):
            at = symbol * STATES + state
            begins = symbol >= SYMBOLS
            following[at], starts[at] = step(FRESH if begins else state, symbol % SYMBOLS)
    return following, starts


NEXT, START = transition_tables()
_classes: list[np.ndarray] = []
_vocabularies: dict[str, Vocabulary] = {}


def classes() -> np.ndarray:
    """The class of every code point; made once per process."""
    if not _classes:
        table = np.full(0x110000, SIGN, np.uint8)
        kinds = {"L": LETTER, "N": DIGIT}
        for code in range(0x110000):
            kind = kinds.get(unicodedata.category(chr(code))[0])
            if kind is not None:
                table[code] = kind
        table[WHITE] = RUN
        _classes.append(table)
    return _classes[0]


def symbols(text: str, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbols of some texts laid end to end; begins and ends are those of texts in it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[codes]
    word_next = np.zeros(len(codes), bool)
    word_next[:-1] = kind[1:] != RUN
    word_next[ends - 1] = False
    found = kind.copy()
    last = (kind == RUN) & word_next
    found[last] = SPACE
    found[last & (codes == 0x20)] = BLANK
    quote = np.flatnonzero(codes == ord("'"))
    if len(quote):
        limits = np.append(ends, len(codes))
        room = limits[np.searchsorted(ends, quote, side="right")] - quote
        first = codes[np.minimum(quote + 1, len(codes) - 1)]
        second = codes[np.minimum(quote + 2, len(codes) - 1)]
        short = (room > 1) & np.isin(first, [ord(c) for c in "stmd"])
        pair = ((first == ord("r")) | (first == ord("v"))) & (second == ord("e"))
        pair |= (first == ord("l")) & (second == ord("l"))
        found[quote[short]] = SHORT
        found[quote[(room > 2) & pair]] = LONG
    found[begins] += SYMBOLS
    return found


def scan(found: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """Where pre-tokens start, and the state behind the last symbol."""
    n = len(found)
    # Identity would be needed to pad; a symbol cannot be one, so the rest goes apart.
    blocks, rest = divmod(n, BLOCK)
    before = np.empty(n, np.uint8)
    if blocks:
        table = found[: blocks * BLOCK].astype(np.uint16).reshape(blocks, BLOCK).T * STATES
        table = np.ascontiguousarray(table)
        functions = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
        for row in table:
            functions = NEXT[row[:, None] + functions]
        entry = np.empty(blocks, np.uint8)
        for i, function in enumerate(functions.tolist()):
            entry[i] = state
            state = function[state]
        states = np.empty((BLOCK, blocks), np.uint8)
        for k, row in enumerate(table):
            states[k] = entry
            entry = NEXT[row + entry]
        before[: blocks * BLOCK] = states.T.reshape(-1)
    following = NEXT.tolist()
    for i in range(blocks * BLOCK, n):
        before[i] = state
        state = following[int(found[i]) * STATES + state]
    return START[found.astype(np.uint16) * STATES + before], state


def starts(text: str, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Offsets of all pre-tokens of some texts laid end to end."""
    if len(text) <= 2 * CHUNK:
        return np.flatnonzero(scan(symbols(text, begins, ends), FRESH)[0])
    parts, state = [], FRESH
    for a in range(0, len(text), CHUNK):
        b = min(a + CHUNK, len(text))
        # Three more code points to look ahead.
        inside = ends[(ends > a) & (ends <= b + 3)] - a
        own = begins[(begins >= a) & (begins < b)] - a
        found, state = scan(symbols(text[a : b + 3], own, inside)[: b - a], state)
        parts.append(np.flatnonzero(found) + a)
    return np.concatenate(parts)


class Vocabulary(dict):
    """Ids of slices by rank merges: a dictionary that computes what it does not have."""

    def __init__(self, content: bytes):
        super().__init__()
        pairs = (line.split() for line in content.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def __missing__(self, piece: str) -> Sequence[int]:
        data = piece.encode("utf-8")
        rank = self.ranks.get(data)
        if rank is not None:
            ids: Sequence[int] = (rank,)
        else:
            ids = self.merged(data) if len(data) < HEAP_FROM else self.merged_long(data)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Join the pair of lowest rank, the leftmost first, until none is left."""
        get, none = self.ranks.get, len(self.lengths)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            whole = parts[i] + parts.pop(i + 1)
            parts[i] = whole
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + whole, none)
            if i < len(pairs):
                pairs[i] = get(whole + parts[i + 1], none)
        return tuple(map(self.ranks.__getitem__, parts))

    def merged_long(self, data: bytes) -> tuple[int, ...]:
        """The same with a heap of pairs and links between neighbours."""
        get, n = self.ranks.get, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is joined
        heap = [
            (rank, i, i + 2) for i in range(n - 1) if (rank := get(data[i : i + 2])) is not None
        ]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                right = end[after[i]]
                rank = get(data[i:right])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, right))
            if before[i] >= 0:
                rank = get(data[before[i] : stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, before[i], stop))
        return tuple(self.ranks[data[i : end[i]]] for i in range(n) if end[i])

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each text has."""
        text = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        begins = np.concatenate([[0], ends[:-1]])
        filled = ends > begins
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        at = starts(text, begins[filled], ends[filled])
        stops = [*at[1:].tolist(), len(text)]
        pieces = [self[text[a:b]] for a, b in zip(at.tolist(), stops)]
        ids = np.fromiter(chain.from_iterable(pieces), np.int32)
        sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64))])
        first, behind = np.searchsorted(at, begins), np.searchsorted(at, ends)
        return ids, sizes[behind] - sizes[first]

    def ends(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The byte offset in its text at which each token ends."""
        total = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        text_start = np.concatenate([[0], np.cumsum(counts)])[:-1]
        return total[1:] - np.repeat(total[text_start], counts)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """The bytes of one text; each token is put where its offset says."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        at = np.arange(int(ends[-1])) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.bytes[at].tobytes()


def grouped(texts: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``CHUNK`` characters."""
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def int_lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def shared_vocabulary(frame: DataFrame, path: str):
    """The vocabulary file, about a megabyte, sent to every executor once.

    A worker process keeps the vocabulary with its cached slices from task to task.
    """
    with open(path, "rb") as file:
        data = file.read()
    key, content = hashlib.sha256(data).hexdigest(), frame.sparkSession.sparkContext.broadcast(data)

    def get() -> Vocabulary:
        if key not in _vocabularies:
            _vocabularies[key] = Vocabulary(content.value)
        return _vocabularies[key]

    return get


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows with their text replaced by ``ids`` and ``ends``.

    ``ends`` has the byte offset in the UTF-8 text at which each token ends. Further
    columns of these names are replaced too.
    """
    others = [c for c in docs.columns if c not in (text, "ids", "ends")]
    rows = docs.select(*others, whole(text).alias("_text"))
    schema = docs.select(*others, F.expr("array(0)").alias("ids"), F.expr("array(0)").alias("ends"))
    vocabulary = shared_vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary()
        for batch in batches:
            texts = batch.column(len(others)).to_pylist()
            for a, b in grouped(texts):
                ids, counts = words.encode(texts[a:b])
                columns = [batch.column(i).slice(a, b - a) for i in range(len(others))]
                lists = [int_lists(ids, counts), int_lists(words.ends(ids, counts), counts)]
                yield pa.RecordBatch.from_arrays([*columns, *lists], [*others, "ids", "ends"])

    return rows.mapInArrow(run, schema.schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with ``ids`` and ``ends`` replaced by ``decoded``, the bytes of the text."""
    others = [c for c in encoded.columns if c not in ("ids", "ends", "decoded")]
    rows = encoded.select(*others, "ids", "ends")
    schema = encoded.select(*others, F.lit(b"").alias("decoded")).schema
    vocabulary = shared_vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary()
        for batch in batches:
            ids, ends = batch.column(len(others)), batch.column(len(others) + 1)
            columns = [batch.column(i) for i in range(len(others))]
            out = [
                words.decode(i.values.to_numpy(False), e.values.to_numpy(False).astype(np.int64))
                for i, e in zip(ids, ends)
            ]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(out, pa.binary())], [*others, "decoded"]
            )

    return rows.mapInArrow(run, schema)


def token_table(docs: DataFrame, path: str, row_id: str = "doc_id") -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    rows = encode(docs.select(F.col(row_id).alias("doc_id"), "text"), path)
    numbers = F.array_join(F.col("ids").cast("array<string>"), " ")
    listed = rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(numbers, 256).alias("ids_sha256"),
        "ids",
        "ends",
    )
    return decode(listed, path).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )
