"""The pipeline against brute-force versions of its stages, one after the other."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from oracles import WORD, base_counts, best_sum, quality as brute_ratios, targets

import corpus_pipeline
from tickloom.llm import quality
from tickloom.llm.bpe import Vocabulary
from tickloom.llm.queries import VOCABULARY
from tickloom.llm.support import written


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The documents and the rows that every stage leaves."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = [docs]
    for _, stage in corpus_pipeline.STAGES:
        left.append(written(stage(spark, left[-1], sf_dir), "stage"))
    return [frame.collect() for frame in left]


def test_columns(stages):
    for rows in stages[1:-1]:
        assert tuple(rows[0].__fields__) == tuple(stages[0][0].__fields__)


def test_quality(spark, sf_dir, stages):
    docs = [(r.doc_id, r.text) for r in stages[0]]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    ratios = brute_ratios(docs, {r.doc_id for r in labels if r.quality == 1 and not r.toxic})
    want = []
    for (doc, text), ratio in zip(docs, ratios):
        n, _, _, _, repeated = base_counts(text)
        if n >= 20 and 100 * repeated <= 30 * n and ratio >= quality.THRESHOLD:
            want.append(doc)
    assert sorted(r.doc_id for r in stages[1]) == sorted(want)


def test_exact(stages):
    best = {}
    for r in stages[1]:
        best[r.text] = max(best.get(r.text, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in stages[2]) == sorted(best.values())


def test_near(stages):
    sets, root = {}, {}
    for r in stages[2]:
        w = WORD.findall(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        root[r.doc_id] = r.doc_id

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                a_root, b_root = sorted((find(a), find(b)))
                root[b_root] = a_root
    assert sorted(r.doc_id for r in stages[3]) == sorted({find(x) for x in ids})


def test_mix(stages):
    rows = {r.doc_id: r for r in stages[3]}
    sizes, lengths = {}, {}
    for r in stages[3]:
        n = len(WORD.findall(r.text))
        sizes[r.source] = sizes.get(r.source, 0) + n
        lengths.setdefault(r.source, []).append(n)
    order = sorted(sizes)
    taken = dict.fromkeys(order, 0)
    for r in stages[4]:
        assert r == rows[r.doc_id]
        taken[r.source] += len(WORD.findall(r.text))
    for s, goal in zip(order, targets([sizes[s] for s in order], (3, 1, 2), 1.5, 2)):
        whole, rest = divmod(goal, sizes[s])
        assert taken[s] == int(whole) * sizes[s] + best_sum(lengths[s], round(rest))


def test_encoding(stages):
    with open(VOCABULARY, "rb") as file:
        ranks = Vocabulary(file.read()).ranks
    known = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    want = []
    for r in stages[4]:
        ids = known.encode_ordinary(r.text)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want.append((r.doc_id, len(ids), digest, hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(tuple(r) for r in stages[5]) == sorted(want)


def test_run(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in stages[-1])


def test_odd_documents(spark, tmp_path):
    """Nulls, empty texts, repeated rows and an extra column go through all stages."""
    good = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, good, "en", "a", 9, "x"), (1, good, "en", "a", 9, "x"), (2, None, "en", None, 0, "x"),
        (None, good + " more", None, None, None, None), (3, "", "de", "b", 0, "x"),
        (4, " ".join(f"z{i}" for i in range(60)), "en", None, 1, "x"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, frame in (("some", docs), ("none", docs.limit(0))):
        folder = f"{tmp_path}/{name}"
        frame.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        left = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            left = written(stage(spark, left, folder), "stage")
            assert left.columns == docs.columns
        ids = sorted((r.doc_id for r in corpus_pipeline.run(spark, folder).collect()), key=str)
        assert set(ids) <= {1, None, 4} and (name == "some") == bool(ids)
