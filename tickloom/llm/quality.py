"""Quality rules: fixed base counts, and a likelihood ratio of hashed n-grams.

The method counts hashed one- and two-grams of the trusted target and of the raw corpus,
turns both into multinomials, and scores a document by the mean log ratio of its n-grams:
how much more likely the target is to produce them than the corpus at large. Every
document with a score of at least ``THRESHOLD`` passes. DataFrame functions only.

The corpus counts cover every document. The target is a bounded sample of labelled
documents: the ``TRUSTED`` of them with the smallest hash of their id, fewer if there are
fewer. Null text counts as empty; a text without a word has zero counts, no score, and
fails the base rule. Without any trusted document all scores are 0. Equal rows get equal
verdicts, and a score equal to the threshold passes. Texts of any length are read whole. An
empty table gives an empty table. Input columns are chosen by name, others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.support import whole, words, written

# Hashed n-grams fall into so many buckets.
BUCKETS = 1 << 14
# Bound of the sample of trusted documents; their ids are broadcast.
TRUSTED = 20_000
# Weight of the corpus in the smoothed target, as a share of the target's n-grams.
SMOOTHING = 0.05
# Mean log ratio from which a document passes: its n-grams are on average at least
# exp(-0.4), two thirds, as likely in the target as in the corpus.
THRESHOLD = -0.4
# The base rule.
LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8

# N-grams are over runs of letters and digits and runs of other signs.
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def bound(value: Column, use) -> Column:
    """Compute a value once and use it in an expression, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def grams(text: Column) -> Column:
    """Buckets of the one- and two-grams of a text, in order."""

    def buckets(tokens: Column) -> Column:
        pairs = F.zip_with(
            tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
        both = F.concat(tokens, F.filter(pairs, lambda p: p.isNotNull()))
        return F.transform(both, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))

    return bound(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), buckets)


def log_ratios(rows: DataFrame, trusted: DataFrame) -> Column:
    """The log ratio of every bucket, as one constant array of ``BUCKETS`` numbers.

    ``rows`` has ``doc_id`` and ``_grams``. The corpus is counted at once; only these numbers
    come to the driver. ``trusted`` has ``doc_id``, at most ``TRUSTED`` rows and no row twice.
    """
    ids = trusted.select(F.col("doc_id").alias("_trusted"))
    marked = rows.select("doc_id", "_grams").join(
        F.broadcast(ids), F.col("doc_id") == F.col("_trusted"), "left"
    )
    counts = (
        marked.select(
            F.col("_trusted").isNotNull().cast("long").alias("target"),
            F.explode("_grams").alias("bucket"),
        )
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("target").alias("target"))
    )
    every = rows.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(counts, "bucket", "left").na.fill(0)
    table = filled.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("all"),
        F.sum("raw").alias("all_raw"),
        F.sum("target").alias("all_target"),
    )
    weight = F.col("all_target") * SMOOTHING + 1

    def ratio(x: Column) -> Column:
        raw = (x.raw + 1) / (F.col("all_raw") + BUCKETS)
        return F.log((x.target + weight * raw) / (F.col("all_target") + weight) / raw)

    ratios = table.select(F.to_json(F.transform("all", ratio))).first()[0]
    return F.from_json(F.lit(ratios), "array<double>")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of trusted documents: good, not toxic, and at most ``TRUSTED`` of them."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL")
    return (
        good.select("doc_id")
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRUSTED)
    )


def window_hashes(w: Column) -> Column:
    """Hashes of the windows of ``WINDOW`` words, a power of two, of at least so many words.

    The hash of a window is that of its halves' hashes, so a word is hashed once.
    """

    def doubled(size: int, hashes: Column) -> Column:
        if size == WINDOW:
            return hashes
        longer = F.transform(
            F.slice(hashes, 1, F.size(hashes) - size),
            lambda h, i: F.xxhash64(h, F.get(hashes, i + size)),
        )
        return bound(longer, lambda h: doubled(2 * size, h))

    return bound(F.transform(w, lambda x: F.xxhash64(x)), lambda h: doubled(1, h))


def repeated_words(w: Column) -> Column:
    """How many words are in windows of ``WINDOW`` words that the text has twice or more.

    Window hashes show quickly that no window repeats; only where some do are windows
    sorted and compared in full. ``w`` is used often and should be bound or a column.
    """
    starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    distinct = bound(window_hashes(w), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    ordered = F.array_sort(
        F.transform(
            starts,
            lambda i: F.struct(
                F.array_join(F.slice(w, i, WINDOW), " ").alias("window"), i.alias("at")
            ),
        )
    )

    def covered(s: Column) -> Column:
        n = F.size(s)
        same = F.zip_with(
            F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: a.window == b.window
        )
        return bound(
            same,
            lambda e: bound(
                F.array_sort(
                    F.transform(
                        F.filter(
                            F.zip_with(
                                s,
                                F.zip_with(
                                    F.concat(F.array(F.lit(False)), e),
                                    F.concat(e, F.array(F.lit(False))),
                                    lambda a, b: a | b,
                                ),
                                lambda x, twice: F.struct(x.at.alias("at"), twice.alias("t")),
                            ),
                            lambda x: x.t,
                        ),
                        lambda x: x.at,
                    )
                ),
                # A window adds its words up to where the next one starts.
                lambda p: F.aggregate(
                    F.zip_with(
                        F.slice(p, 1, F.size(p) - 1),
                        F.slice(p, 2, F.size(p) - 1),
                        lambda a, b: F.least(b - a, F.lit(WINDOW)),
                    ),
                    F.lit(WINDOW),
                    lambda total, x: total + x,
                ),
            ),
        )

    return F.when(
        F.size(w) > WINDOW,
        F.when(distinct, F.lit(0)).otherwise(bound(ordered, covered)),
    ).otherwise(F.lit(0))


def base_counts(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The base figures of every document, beside the untouched text."""
    content = whole(text)
    lines = F.filter(F.split(content, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    counted = docs.select(
        F.col(row_id).alias("doc_id"),
        content.alias("_text"),
        words(content).alias("_words"),
        lines.alias("_lines"),
    )
    return counted.select(
        "doc_id",
        "_text",
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        (F.size(F.split("_text", SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )


def mean_ratio(found: Column, ratios: Column) -> Column:
    """Sum of the log ratios of a text's n-grams over their number."""

    def mean(g: Column) -> Column:
        total = F.aggregate(
            g, F.lit(0.0), lambda t, b: t + F.element_at(ratios, b + 1)
        )
        return F.when(F.size(g) > 0, total / F.size(g))

    return bound(found, mean)


def judge(
    docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Counts and verdict of every document.

    Texts are read once: their figures and n-grams are written, about as much as the texts.
    """
    counted = base_counts(docs, row_id, text)
    counted = written(counted.select("*", grams(F.col("_text")).alias("_grams")).drop("_text"), "grams")
    ratios = log_ratios(counted, trusted_ids(labels))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    scored = counted.select(
        "*", failed.alias("base_failed"), mean_ratio(F.col("_grams"), ratios).alias("log_ratio")
    )
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "log_ratio",
        (~F.col("base_failed") & (F.col("log_ratio") >= THRESHOLD)).alias("kept"),
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, row_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents that pass, with their columns as they are."""
    content = whole(text)
    found = docs.select(F.col(row_id).alias("doc_id"), grams(content).alias("_grams"))
    ratios = log_ratios(found, trusted_ids(labels))
    base = bound(
        words(content),
        lambda w: (F.size(w) >= LEAST_WORDS)
        & (100 * repeated_words(w) <= MOST_REPEATED * F.size(w)),
    )
    return docs.where(base & (mean_ratio(grams(content), ratios) >= THRESHOLD))
