"""Byte-level BPE against a reference tokenizer, and whole round trips."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import bpe
from tickloom.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def words():
    with open(PATH, "rb") as file:
        return bpe.Vocabulary(file.read())


@pytest.fixture(scope="module")
def known(words):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={}
    )


def check(words, known, texts):
    ids, counts = words.encode(texts)
    ends = words.ends(ids, counts)
    at = np.concatenate([[0], np.cumsum(counts)])
    for k, text in enumerate(texts):
        own = ids[at[k] : at[k + 1]]
        assert own.tolist() == known.encode_ordinary(text)
        assert words.decode(own, ends[at[k] : at[k + 1]]) == text.encode()


ODD = st.text(alphabet="'stmdrvel  \n\t  aB9½é漢🙂.,#", max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(ODD, st.text(max_size=30)), min_size=1, max_size=5))
def test_any_texts(words, known, texts):
    check(words, known, texts)


def test_block_and_chunk_borders(words, known, monkeypatch):
    text = "it's we'll\n\n 12  ''s 've x'" * 40
    for chunk in (1, 2, 3, 7, 64):
        monkeypatch.setattr(bpe, "CHUNK", chunk)
        monkeypatch.setattr(bpe, "BLOCK", 5)
        check(words, known, [text, "", "'", "'s" * 30, " " * 33])


def test_long_runs(words, known):
    check(words, known, ["ab" * 3000, "x" * 2000, " " * 5000, "é" * 700, "!?" * 900])


def test_heap_equals_loop(words):
    for text in ("thequickbrownfox" * 4, "aaaaaaa", "ab", "zzzzé漢"):
        assert words.merged(text.encode()) == words.merged_long(text.encode())


def test_query(spark, sf_dir, known):
    want = {}
    for row in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = known.encode_ordinary(row.text or "")
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want[row.doc_id] = (len(ids), digest, hashlib.sha256((row.text or "").encode()).hexdigest())
    got = QUERIES["op9_bpe"](spark, sf_dir).collect()
    assert len(got) == len(want)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_edges(spark):
    rows = [(1, None, "x", "y"), (1, "", "x", "y"), (None, "a b", "x", "y"), (2, "a b", None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, ends string")
    got = bpe.token_table(docs, PATH).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.n_tokens, r.decoded_sha256 == empty) for r in got) == [
        (0, True), (0, True), (2, False), (2, False)
    ]
    assert bpe.token_table(docs.limit(0), PATH).collect() == []
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(bytes(r.decoded) for r in back) == [b"", b"", b"a b", b"a b"]
