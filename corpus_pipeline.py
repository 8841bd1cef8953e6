"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, mixing, encoding.

Every stage takes the session, the documents its predecessor kept, and the folder of the
tables. ``run`` writes each stage's rows to the shared folder and reads them again for
the next one, so nothing is computed twice and a lost executor costs one stage at most.
Columns beside those of ``documents`` are carried along up to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bpe, exact, jaccard, mixing, quality
from tickloom.llm.queries import VOCABULARY
from tickloom.llm.support import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the likelihood ratio."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest id."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar n-gram sets, the one with the least id."""
    return jaccard.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: some sources lose some, others repeat."""
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix."""
    return bpe.token_table(docs, VOCABULARY)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram join", near_dedup),
    ("source mix", source_mix),
    ("byte-pair encoding", encoding),
]

# Seeded hashes, dynamic programming and byte-pair merges are not SQL; the tests hold
# the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
