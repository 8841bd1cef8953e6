"""Quality rules against plain counters."""

import pytest
from oracles import base_counts, quality as brute_ratios

from pyspark.sql import functions as F

from tickloom.llm import quality
from tickloom.llm.queries import QUERIES


def check(docs, trusted, got):
    ratios = brute_ratios(docs, trusted)
    want = {}
    for (doc, text), ratio in zip(docs, ratios):
        counts = base_counts(text)
        failed = counts[0] < 20 or 100 * counts[4] > 30 * counts[0]
        want[doc] = (counts, failed, ratio)
    assert len(got) == len(docs)
    for r in got:
        counts, failed, ratio = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == failed
        if ratio is None:
            assert r.log_ratio is None
        else:
            assert r.log_ratio == pytest.approx(ratio, abs=1e-9)
        assert r.kept == (not failed and ratio >= quality.THRESHOLD)


def test_query(spark, sf_dir):
    docs = [
        (r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    trusted = {r.doc_id for r in labels if r.quality == 1 and not r.toxic}
    check(docs, trusted, QUERIES["op8_quality"](spark, sf_dir).collect())


WORDS = " ".join(f"w{i}" for i in range(30))
ROWS = [
    (1, WORDS), (2, None), (3, ""), (4, " \n\t"), (5, WORDS + "\n" + WORDS + "\n\n" + WORDS),
    (6, "a " * 60), (7, "x é漢 #*$ <>|&% " * 9), (8, "one\none\n \none\ntwo"),
    (9, " ".join(f"w{i}" for i in range(8)) + " y " + " ".join(f"w{i}" for i in range(8))),
    (10, WORDS.replace(" ", " ")), (11, "long" * 50_000), (12, "a b c d e f g h a b c d e f g h"),
    (13, "a_b __ c_d"),
]


def test_edges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (5, 1, 1), (7, 1, None), (6, 0, 0), (None, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    check(ROWS, {1, 7}, quality.judge(docs, labels).collect())
    none = labels.limit(0)
    check(ROWS, set(), quality.judge(docs, none).collect())
    assert quality.judge(docs.limit(0), labels).collect() == []


def test_keep_good(spark):
    rows = [(d, t, d) for d, t in ROWS] + [(1, WORDS, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _words long")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    verdict = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, _ in rows if d in verdict)


def test_repeated_words_of_long_text(spark):
    text = " ".join(f"w{i}" for i in range(150_000))
    docs = spark.createDataFrame([(1, text + " " + text)], "doc_id long, text string")
    row = quality.base_counts(docs).first()
    assert (row.n_words, row.n_repeat_words) == (300_000, 300_000)


def test_texts_are_read_once(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    judged = quality.judge(docs, labels)
    assert not any(str(tmp_path) in path for path in judged.inputFiles())
    check(ROWS, {1}, judged.collect())


def test_window_hashes_tell_windows_apart(spark):
    texts = ["a b c d e f g h " * 2, "a b c d e f g h i a b c d e f g", "1 2 3 4 5 6 7 8 9"]
    docs = spark.createDataFrame([(t.split(),) for t in texts], "w array<string>")
    for row in docs.select("w", quality.window_hashes(F.col("w")).alias("h")).collect():
        windows = [tuple(row.w[i : i + 8]) for i in range(len(row.w) - 7)]
        assert len(row.h) == len(windows) and len(set(row.h)) == len(set(windows))
