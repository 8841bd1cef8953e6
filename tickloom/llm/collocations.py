"""Phrase collocations per language, from Rabin-Karp fingerprints of every n-gram.

Texts are normalised (A-Z to lower case, words of a piece joined by one space, pieces by a
line feed), gathered by language into packs of about ``PACK`` bytes and written once.

1. In each pack, prefix polynomials of its bytes, modulo two primes, give the fingerprint of
   every n-gram of 1 to ``LONGEST`` words. Per pack and bucket of fingerprints one row holds
   the distinct ones, with how often the pack has each: pack, bucket and position in that row
   point to the occurrences.
2. Rows are shuffled by bucket and added up. What has at least ``LEAST`` occurrences is told
   back to each pack, as one bit per fingerprint that it sent.
3. Packs slice out and count the text of the marked occurrences alone. Grouping by that text
   verifies the fingerprints: whatever shared one without being equal is counted apart, and
   phrases below ``LEAST`` go. So counts are exact whatever collides.
4. Scores, the removal of parts of longer phrases and the ranks are joins and aggregates over
   frequent phrases. Products are decimals of 38 digits, exact up to 10^16 occurrences.

The number of buckets grows with the corpus, so that a bucket fits a task; a frequent n-gram has
one entry per pack in it. Languages of any size are dealt over packs and buckets. The last
ranking per language is over the best of each of ``SALTS`` parts.

Null text counts as empty, null language as ``und``, together with rows that say so. A text
without a word adds nothing. A text larger than a pack is cut between words, and the
n-grams across the cut belong to the part they begin in. Repeated rows count as often as they
occur. Ties in score and count are ranked by the phrase's bytes. An empty table gives an
empty table. Input columns are chosen by name, others may have any name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.support import settings, spread_join, whole, written
from tickloom.llm.word_hashes import mix

LONGEST, LEAST, TOP = 3, 10, 2_000
# A phrase goes if a longer one has at least this share of its occurrences, in per cent.
INSIDE = 50
# Bytes of text of a pack; larger packs shuffle fewer fingerprints and take more memory.
PACK = 1 << 20
# Entries that a bucket should have.
BUCKET = 1 << 20
SALTS = 64
# Bytes of a row group of packs, and packs that a reader takes at once: what is around a pack
# in its file does not count for the memory of a task.
GROUP = 4 * PACK
READ_SETTINGS = {"spark.sql.parquet.columnarReaderBatchSize": "4"}
# Fingerprints travel as the number of their bucket and this many bytes.
KEY_BYTES = 6

# Primes below 2^31, and a base for each.
_PRIMES = ((2_147_483_647, 1_566_083_941), (2_147_483_629, 1_812_433_253))
# Bytes whose weights are summed up at once; sums stay below 2^63.
_STRIDE = 1 << 18

_SPLIT = re.compile(rb"[.,;:!?\x0A-\x0D]")
_GAP = re.compile(rb"[ \n]")
_AHEAD = re.compile(rb"[^ \n]+(?: [^ \n]+){0,%d}" % (LONGEST - 2))

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def normal(text: str) -> bytes:
    """Words of a piece joined by a space, pieces joined by a line feed."""
    pieces = (b" ".join(p.split()) for p in _SPLIT.split(text.encode().lower()))
    return b"\n".join(p for p in pieces if p)


def segments(body: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """A long body in parts, each with how many of its bytes n-grams may begin in."""
    at = 0
    while len(body) - at > 2 * size:
        gap = _GAP.search(body, at + size)
        if gap is None:
            break
        cut = gap.end()
        stop = cut - 1 if gap[0] == b"\n" else _AHEAD.match(body, cut).end()
        yield body[at:stop], cut - at
        at = cut
    yield body[at:], len(body) - at


def word_number(body: bytes, own: int) -> int:
    head = body[:own]
    if not head:
        return 0
    return head.count(b" ") + head.count(b"\n") + (head[-1:] not in b" \n")


def pack_table(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """Packs: pack, lang, own, words, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        number, held = 0, 0
        waiting: dict[str, list[bytes]] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)

        def row(name: str, body: bytes, own: int) -> pa.RecordBatch:
            nonlocal number
            number += 1
            values = [task + number, name, own, word_number(body, own), body]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(values, kinds)],
                ["pack", "lang", "own", "words", "body"],
            )

        def flush(name: str) -> pa.RecordBatch:
            nonlocal held
            body = b"\n".join(waiting.pop(name))
            held -= sizes.pop(name)
            return row(name, body, len(body))

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = normal(content.as_py())
                *parts, (body, _) = segments(body, PACK)
                for part in parts:
                    yield row(name, *part)
                if not body:
                    continue
                waiting[name].append(body)
                sizes[name] += len(body)
                held += len(body)
                if sizes[name] >= PACK:
                    yield flush(name)
                while held > 4 * PACK:
                    yield flush(max(sizes, key=sizes.get))
        for name in list(waiting):
            yield flush(name)

    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        whole(text).alias("text"),
    )
    schema = "pack long, lang string, own long, words long, body binary"
    return written(rows.mapInArrow(run, schema), "packs", **{"parquet.block.size": GROUP})


def _powers(k: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0, base^1, ... and the same of its inverse, modulo the k-th prime."""
    if k not in _tables:
        prime, base = _PRIMES[k]
        found = []
        for b in (base % prime, pow(base, -1, prime)):
            table = np.ones(_STRIDE + 1, np.uint64)
            size = 1
            # Double the table: the next ``size`` powers are the first ones times b^size.
            while size <= _STRIDE:
                step = np.uint64(pow(b, size, prime))
                more = table[: min(size, _STRIDE + 1 - size)]
                table[size : size + len(more)] = more * step % np.uint64(prime)
                size *= 2
            found.append(table)
        _tables[k] = found[0], found[1]
    return _tables[k]


def prefix_values(data: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """The polynomial of the first ``p`` bytes, for ascending places p."""
    prime = np.uint64(_PRIMES[k][0])
    up, down = _powers(k)
    out = np.zeros(len(places), np.uint64)
    carry = np.uint64(0)
    for at in range(0, len(data), _STRIDE):
        part = data[at : at + _STRIDE]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * down[1 : len(part) + 1], out=total[1:])
        a, b = np.searchsorted(places, [at, at + len(part)], side="right")
        a = 0 if at == 0 else a
        inside = places[a:b] - at
        out[a:b] = (carry + total[inside]) % prime * up[inside] % prime
        carry = (carry + total[-1]) % prime * up[len(part)] % prime
    return out


def length_powers(lengths: np.ndarray, k: int) -> np.ndarray:
    """base^length modulo the k-th prime."""
    up, _ = _powers(k)
    prime, base = _PRIMES[k]
    out = up[np.minimum(lengths, _STRIDE)]
    for i in np.flatnonzero(lengths > _STRIDE).tolist():
        out[i] = pow(base, int(lengths[i]), prime)
    return out


def grams(body: bytes, own: int, seed: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, starts and ends of all n-grams of a pack that begin in its own bytes.

    ``seed`` tells languages apart. The first of so many bits that matter are the bucket.
    """
    data = np.frombuffer(body, np.uint8)
    gap = (data == 0x20) | (data == 0x0A)
    gaps = np.flatnonzero(gap)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(data)]])
    # Whether the next word is in the same piece.
    linked = np.append(data[gaps] == 0x20, False)
    places = np.empty(2 * len(starts), np.int64)
    places[0::2], places[1::2] = starts, ends
    values = [prefix_values(data, places, k) for k in range(len(_PRIMES))]
    alive = starts < own
    prints, froms, tos = [], [], []
    for n in range(1, LONGEST + 1):
        if n > 1:
            alive = alive[: len(starts) - n + 1] & linked[n - 2 : len(starts) - 1]
        first = np.flatnonzero(alive)
        a, b = starts[first], ends[first + n - 1]
        joined = np.zeros(len(first), np.uint64)
        for k, (prime, _) in enumerate(_PRIMES):
            p = np.uint64(prime)
            before = values[k][2 * first] * length_powers(b - a, k) % p
            joined = joined << np.uint64(31) | (values[k][2 * (first + n - 1) + 1] + p - before) % p
        prints.append(joined)
        froms.append(a)
        tos.append(b)
    found = mix(np.concatenate(prints) ^ np.uint64(seed))
    drop = max(0, 64 - 8 * KEY_BYTES - bits)
    return found >> np.uint64(drop), np.concatenate(froms), np.concatenate(tos)


def lang_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode())


def distinct(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints and their numbers."""
    prints = np.sort(prints)
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
    return prints[first], np.diff(np.append(first, len(prints)))


def bucket_rows(prints: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Bucket and range of its entries, of sorted fingerprints."""
    bucket = (prints >> np.uint64(min(8 * KEY_BYTES, 64 - bits))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(prints)])


def fingerprint_rows(packs: DataFrame, bits: int) -> DataFrame:
    """Per pack and bucket: bucket, pack, prints (6 bytes each), counts (4 bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pylist()
            for i, pack in enumerate(batch.column(0).to_pylist()):
                body = batch.column(3)[i].as_py()
                found, _, _ = grams(body, batch.column(2)[i].as_py(), lang_seed(names[i]), bits)
                prints, counts = distinct(found)
                low = prints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
                keys = low.tobytes()
                counts = counts.astype("<u4").tobytes()
                rows = [
                    (b, keys[s * KEY_BYTES : e * KEY_BYTES], counts[s * 4 : e * 4])
                    for b, s, e in bucket_rows(prints, bits)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array(np.full(len(rows), pack)),
                        pa.array([r[1] for r in rows], pa.binary()),
                        pa.array([r[2] for r in rows], pa.binary()),
                    ],
                    ["bucket", "pack", "prints", "counts"],
                )

    return packs.select("pack", "lang", "own", "body").mapInArrow(
        run, "bucket long, pack long, prints binary, counts binary"
    )


def frequent(part: pa.Table) -> pa.Table:
    """Of one bucket: per pack, a bit for each of its fingerprints: whether it is frequent."""
    keys = part["prints"].to_pylist()
    low = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY_BYTES)
    prints = np.zeros((len(low), 8), np.uint8)
    prints[:, :KEY_BYTES] = low
    prints = prints.view("<u8").ravel()
    counts = np.frombuffer(b"".join(part["counts"].to_pylist()), "<u4").astype(np.int64)
    order = np.argsort(prints, kind="stable")
    ordered = prints[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    good = np.add.reduceat(counts[order], first) >= LEAST
    marks = np.zeros(len(prints), bool)
    marks[order] = np.repeat(good, np.diff(np.append(first, len(prints))))
    at = np.cumsum([0, *[len(k) // KEY_BYTES for k in keys]])
    told = [
        (i, np.packbits(marks[at[i] : at[i + 1]]).tobytes())
        for i in range(len(keys))
        if marks[at[i] : at[i + 1]].any()
    ]
    return pa.table(
        {
            "pack": part["pack"].take(pa.array([i for i, _ in told], pa.int64())),
            "bucket": part["bucket"].take(pa.array([i for i, _ in told], pa.int64())),
            "marks": pa.array([m for _, m in told], pa.binary()),
        }
    )


def phrase_counts(packs: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """Counts of the marked n-grams by their text: lang, phrase, n_words, f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(batch.column(0).to_pylist()):
                body = batch.column(2)[i].as_py()
                found, a, b = grams(body, batch.column(1)[i].as_py(), lang_seed(name), bits)
                prints, _ = distinct(found)
                told = {m["bucket"]: m["marks"] for m in batch.column(3)[i].as_py()}
                good = np.zeros(len(prints), bool)
                for bucket, s, e in bucket_rows(prints, bits):
                    if bucket in told:
                        marked = np.frombuffer(told[bucket], np.uint8)
                        good[s:e] = np.unpackbits(marked, count=e - s)
                keep = np.flatnonzero(good[np.searchsorted(prints, found)])
                counts = Counter(
                    map(body.__getitem__, map(slice, a[keep].tolist(), b[keep].tolist()))
                )
                phrases = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(phrases), pa.string()),
                        pa.array(phrases, pa.binary()).cast(pa.string()),
                        pa.array([p.count(b" ") + 1 for p in phrases], pa.int32()),
                        pa.array(list(counts.values()), pa.int64()),
                    ],
                    ["lang", "phrase", "n_words", "f"],
                )

    told = marks.groupBy("pack").agg(F.collect_list(F.struct("bucket", "marks")).alias("told"))
    return (
        packs.join(told, "pack")
        .select("lang", "own", "body", "told")
        .mapInArrow(run, "lang string, phrase string, n_words int, f long")
        .groupBy("lang", "phrase", "n_words")
        .agg(F.sum("f").alias("f"))
        .where(F.col("f") >= LEAST)
    )


def frequent_phrases(packs: DataFrame, words: int) -> DataFrame:
    """All phrases of 1 to ``LONGEST`` words with ``LEAST`` occurrences or more, written."""
    buckets = max(1, LONGEST * words // BUCKET)
    bits = buckets.bit_length()
    marks = fingerprint_rows(packs, bits).groupBy("bucket").applyInArrow(
        frequent, "pack long, bucket long, marks binary"
    )
    with settings(packs.sparkSession, READ_SETTINGS):
        return written(phrase_counts(packs, written(marks, "marks"), bits), "phrases")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut: lang, phrase, n_words, a, l, r, score."""
    # No phrase holds a line feed.
    key = F.concat("phrase", F.lit("\n"), "lang")
    known = phrases.select(key.alias("key"), "f")
    candidates = phrases.where("n_words > 1").withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.withColumns(
        {
            "_l": F.expr(r"concat(substring_index(phrase, ' ', k), '\n', lang)"),
            "_r": F.expr(r"concat(substring_index(phrase, ' ', k - n_words), '\n', lang)"),
        }
    )
    for side in ("l", "r"):
        table = known.select(F.col("key").alias(f"_{side}"), F.col("f").alias(side))
        table = table.withColumn("_f", F.col(side))
        cuts = spread_join(cuts, table, f"_{side}", "_f", ["phrase", "k"]).drop("_f")
    a, left, right = (F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r"))
    cuts = cuts.withColumns({"_top": a * a * F.lit(1_000_000), "_bottom": left * right})
    cuts = cuts.withColumn("score", F.expr("_top div _bottom"))
    return (
        cuts.groupBy("lang", "phrase", "n_words")
        .agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("_m"))
        .select("lang", "phrase", "n_words", "a", "_m.l", "_m.r", "_m.score")
    )


def outermost(candidates: DataFrame) -> DataFrame:
    """Candidates without those that mostly occur inside a longer one."""
    parts = []
    for size in range(2, LONGEST):
        inside = candidates.where(F.col("n_words") > size).withColumn(
            "_at", F.explode(F.sequence(F.lit(1), F.col("n_words") - size + 1))
        )
        words = F.slice(F.split("phrase", " "), F.col("_at"), size)
        parts.append(inside.select("lang", F.array_join(words, " ").alias("phrase"), "a"))
    held = parts[0]
    for part in parts[1:]:
        held = held.unionByName(part)
    held = held.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = candidates.join(held, ["lang", "phrase"], "left")
    covered = 100 * F.coalesce("_longer", F.lit(0)) >= INSIDE * F.col("a")
    return kept.where(~covered).drop("_longer")


def best(candidates: DataFrame, top: int) -> DataFrame:
    """The first candidates of each language, with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = candidates.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rank = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))
    few = dealt.withColumn("rank", rank).where(F.col("rank") <= top).drop("_salt")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return few.withColumn("rank", rank).where(F.col("rank") <= top)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP
) -> DataFrame:
    """Per language the best phrases: lang, rank, phrase, a, l, r, n, score."""
    packs = pack_table(docs, text, lang)
    totals = written(packs.groupBy("lang").agg(F.sum("words").alias("n")), "totals")
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    candidates = written(scored(frequent_phrases(packs, words)), "candidates")
    return (
        best(outermost(candidates), top)
        .join(totals, "lang")
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
s AS (SELECT d, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM s),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
          FROM w, range(1, {LONGEST + 1}) AS x(size)))
  GROUP BY lang, size, phrase HAVING count(*) >= {LEAST}),
k AS (
  SELECT lang, phrase, size, f AS a, k, string_split(phrase, ' ') AS w
  FROM g, range(1, {LONGEST}) AS x(k) WHERE k < size),
c AS (
  SELECT k.lang, k.phrase, k.size, k.a, k.k, l.f AS l, r.f AS r,
         CAST(CAST(1000000 AS HUGEINT) * k.a * k.a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM k
  JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ')
  JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ')),
m AS MATERIALIZED (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (
  SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '),
                       array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase, a AS longer
  FROM m WHERE size = 3),
o AS (
  SELECT m.* FROM m LEFT JOIN (SELECT lang, phrase, max(longer) AS longer FROM h GROUP BY lang, phrase) x
    ON x.lang = m.lang AND x.phrase = m.phrase
  WHERE 100 * coalesce(longer, 0) < {INSIDE} * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM o JOIN n USING (lang)
QUALIFY rank <= {TOP}
"""
