"""The registered queries of the corpus operators, and the SQL of their results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    bpe,
    collocations,
    exact,
    html_slots,
    hyper_minhash,
    jaccard,
    line_runs,
    mixing,
    quality,
    secret_scan,
    sharding,
    vector_codes,
    windows,
)

Run = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}


def query(run: Run) -> Run:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


SHARDS = 40


@query
def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    equal = [(n, 1.0) for n in range(SHARDS)]
    found = sharding.shard_table(table(spark, sf_dir, "documents"), equal, (SHARDS, 1.0))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), "grown_shard",
    )




def _crc_entry(byte: int) -> int:
    """The checksum table at a byte, from the polynomial of CRC-32."""
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


# The checksum table is linear: an entry is the sum, without carry, of its bits' entries.
_CRC_STEP = reduce(
    lambda left, right: f"xor({left}, {right})",
    [f"(xor(a, x) >> {bit} & 1) * {_crc_entry(1 << bit)}" for bit in range(8)],
)
# MD5 places and orders the records.
ORACLES["op2_shards"] = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key,
         octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h
  FROM documents),
b AS MATERIALIZED (
  SELECT r, doc_id, key, n + 16 AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(h, '..'), lambda b:
               CAST('0x' || b AS BIGINT))),
             lambda a, x: xor(a >> 8, {_CRC_STEP})), 4294967295) AS text_crc32
  FROM d),
s AS (
  SELECT r, j, CAST('0x' || md5(key || ':' || j)[1:13] AS BIGINT) AS u
  FROM b, range({SHARDS + 1}) AS x(j)),
p AS (
  SELECT r, arg_max(j, (u, -j)) FILTER (j < {SHARDS}) AS shard, arg_max(j, (u, -j)) AS grown_shard
  FROM s GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (
         PARTITION BY shard
         ORDER BY md5(key || ':' || text_crc32 || ':' || size)[1:13], doc_id, text_crc32, size
       ) - 1 AS slot,
       CAST(grown_shard AS INTEGER) AS grown_shard
FROM b JOIN p USING (r)
"""


@query
def op6_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.classify(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("digest", "text_sha256")


ORACLES["op6_exact"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The vocabulary file of the installed tokenizers.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_table(table(spark, sf_dir, "documents"), VOCABULARY)


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_table(table(spark, sf_dir, "documents"))


ORACLES["op3_secrets"] = secret_scan.oracle()


@query
def op10_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


@query
def op7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_table(table(spark, sf_dir, "documents"))


ORACLES["op7_windows"] = windows.ORACLE


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_slots.text_table(table(spark, sf_dir, "pages"))


@query
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.line_table(table(spark, sf_dir, "documents"))


ORACLES["op5_lines"] = line_runs.ORACLE


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_table(table(spark, sf_dir, "embeddings"))


ORACLES["op11_vector_codes"] = vector_codes.oracle()


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_collocations"] = collocations.ORACLE


@query
def op13_near_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyper_minhash.near_duplicates(table(spark, sf_dir, "documents"))
