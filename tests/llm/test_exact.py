"""Exact dedup: hot texts, digests that collide, nulls and repeated rows."""

from pyspark.sql import functions as F

from tickloom.llm import exact, support


def verdicts(frame):
    return sorted((tuple(r)[:4] for r in frame.collect()), key=str)


def brute(rows):
    out = []
    for d, t in rows:
        same = [x for x, y in rows if (y or "") == (t or "")]
        best = max((x for x in same if x is not None), default=None)
        out.append((d, best, len(same), d == best))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "b"), (3, "a"), (3, "a"), (4, None), (5, ""), (None, "b"), (None, "c"),
        (6, "x" * 300_000), (7, "x" * 300_000), (8, "a "), (9, "A")]


def weak(text):
    """A digest with three values, so that most texts share theirs."""
    return F.pmod(F.xxhash64(text), F.lit(3)).cast("string")


def test_classify(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    assert verdicts(exact.classify(docs)) == brute(ROWS)
    assert verdicts(exact.classify(docs, digest=weak)) == brute(ROWS)
    assert verdicts(exact.classify(docs.limit(0))) == []


def test_hot_text(spark, monkeypatch):
    monkeypatch.setattr(support, "HOT_ROWS", 10)
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert verdicts(exact.classify(docs)) == brute(rows)


def test_keep_one(spark):
    rows = [(d, t, "s", {"k": 1}, "r") for d, t in ROWS]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, _best string, tags map<string,int>, row string"
    )
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted(
        [(3, "a"), (2, "b"), (5, ""), (None, "c"), (7, "x" * 300_000), (8, "a "), (9, "A")],
        key=str,
    )
    assert exact.keep_one(docs.limit(0)).count() == 0
