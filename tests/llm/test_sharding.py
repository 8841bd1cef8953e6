"""Rendezvous sharding: the query's SQL is checked by the oracle test; here are its laws."""

import zlib
from collections import Counter

from tickloom.llm import sharding
from tickloom.llm.queries import QUERIES


def test_query(spark, sf_dir):
    docs = {
        r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    }
    got = QUERIES["op2_shards"](spark, sf_dir).collect()
    slots = {}
    for r in got:
        text = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(text) + 16, zlib.crc32(text))
        assert r.law == "key" and 0 <= r.shard < 40
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(got) == len(docs)


def test_weights_and_growth(spark):
    rows = spark.range(20_000).select("id")
    shards = [(0, 1.0), (1, 3.0)]
    key = rows.id.cast("string")
    placed = sharding.place(rows, key, shards, (7, 1.0)).collect()
    share = Counter(r.shard for r in placed)
    assert abs(share[1] / 20_000 - 0.75) < 0.02
    moved = [r for r in placed if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {7} and abs(len(moved) / 20_000 - 0.2) < 0.02
    more = sharding.place(rows, key, [*shards, (7, 1.0)]).collect()
    assert {r.id: r.shard for r in more} == {r.id: r.grown_shard for r in placed}


def test_edges(spark):
    rows = [(None, None, 1), (None, "", 1), (1, "a", 1), (1, "a", 1), (2, "é" * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    shards = [(n, 1.0) for n in range(3)]
    got = sharding.shard_table(docs, shards, (3, 1.0)).collect()
    assert sorted(r.size for r in got) == [16, 16, 17, 17, 200_016]
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.shard_table(docs.limit(0), shards, (3, 1.0)).count() == 0
