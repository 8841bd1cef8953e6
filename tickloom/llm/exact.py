"""Exact dedup by skew-safe combining, with DataFrame functions only.

Rows are first combined inside each task, then per digest and salt, then the winners of
the salts are combined. Every stage groups by the digest and the whole text, so texts
that merely share a digest are never merged.

Null text counts as empty. Of equal texts the row with the largest id stays; a null id is
smaller than any other. Rows that repeat the id and the text of the row that stays share
its verdict in ``classify``; ``keep_one`` returns exactly one row per text.
Texts of any length are compared whole. An empty table gives an empty table. Input columns are
chosen by name; others may have any name and are carried along by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.support import spread_join, whole, written

# Winners of the tasks meet in this many groups per text before the last stage.
SALTS = 32


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def combine(
    docs: DataFrame, digest: Column, text: Column, best: Column, order: str = "_best"
) -> DataFrame:
    """One row per distinct text: _digest, _text, _best (the largest by order), _rows."""
    # Which task a row is in decides only where it is combined, never the outcome.
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    dealt = docs.select(
        digest.alias("_digest"), text.alias("_text"), salt.alias("_salt"), best.alias("_best")
    )
    first = F.max("_best") if order == "_best" else F.max_by("_best", order)
    salted = dealt.groupBy("_digest", "_text", "_salt").agg(
        first.alias("_best"), F.count(F.lit(1)).alias("_rows")
    )
    return salted.groupBy("_digest", "_text").agg(
        first.alias("_best"), F.sum("_rows").alias("_rows")
    )


def classify(
    docs: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
) -> DataFrame:
    """Per row: the id, keep_id, group_size, kept, and the digest of its text.

    Rows find their class by digest alone where the classes show that the digest has one
    text only; otherwise digest and whole text are compared.
    """
    content = whole(text)
    classes = combine(docs, digest(content), content, F.col(row_id))
    fingerprint = F.xxhash64("_text")
    known = written(
        classes.select(
            "_digest",
            F.col("_best").alias("keep_id"),
            F.col("_rows").alias("group_size"),
            fingerprint.alias("_fingerprint"),
        ),
        "exact-classes",
    )
    rows = docs.select(F.col(row_id).alias("doc_id"), digest(content).alias("_digest"))
    shared = known.groupBy("_digest").count().where("count > 1").select("_digest")
    if shared.isEmpty():
        found = spread_join(
            rows, known.drop("_fingerprint"), "_digest", "group_size", ["doc_id"]
        )
    else:
        single = known.join(shared, "_digest", "left_anti")
        found = spread_join(
            rows.join(shared, "_digest", "left_anti"),
            single.drop("_fingerprint"),
            "_digest",
            "group_size",
            ["doc_id"],
        )
        full = docs.select(
            F.col(row_id).alias("doc_id"), digest(content).alias("_digest"), content.alias("_text")
        ).join(shared, "_digest", "left_semi")
        split = classes.join(shared, "_digest", "left_semi").select(
            "_digest",
            "_text",
            F.col("_best").alias("keep_id"),
            F.col("_rows").alias("group_size"),
        )
        found = found.unionByName(full.join(split, ["_digest", "_text"]).drop("_text"))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_digest").alias("digest"),
    )


def keep_one(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every distinct text, with all its columns in their order.

    Between rows of equal id and text a hash of the other columns decides.
    """
    others = [c for c in docs.columns if c != text]
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    best = F.struct(
        F.struct(F.col(row_id).alias("id"), F.xxhash64(*hashed).alias("tie")).alias("order"),
        F.col(text).isNull().alias("null"),
        F.struct(*others).alias("row"),
    )
    content = whole(text)
    classes = combine(docs, sha256_hex(content), content, best, "_best.order")
    value = F.when(~F.col("_best.null"), F.col("_text"))
    return classes.select(
        *[
            (value if c == text else F.col("_best.row").getField(c)).alias(c)
            for c in docs.columns
        ]
    )
