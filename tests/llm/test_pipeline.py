from collections import Counter
import re

import pytest

import corpus_pipeline
from helixmill.llm import token_shards
from tests.llm.test_decontaminate import words
from tests.llm.test_ngram_join import sets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, sf).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        out.append(docs)
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]


def test_stages_against_brute_force(spark, stages):
    start, good, single, clean, mixed, shards = stages
    assert all(d.columns == COLUMNS for d in (good, single, clean, mixed))
    rows = [d.collect() for d in stages]
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert {r.doc_id for r in rows[1]} <= {r.doc_id for r in rows[0]} and all(n(r.text) >= 50 for r in rows[1])
    # one of each group: the least doc_id
    ss = {r.doc_id: sets(r.text) for r in rows[1]}
    link = lambda a, b: 100 * len(ss[a] & ss[b]) >= 75 * len(ss[a] | ss[b])
    root = {d: d for d in ss}
    for a in ss:
        for b in ss:
            if b < a and link(a, b):
                x, y = root[a], root[b]
                for d in ss:
                    if root[d] in (x, y):
                        root[d] = min(x, y)
    assert sorted(r.doc_id for r in rows[2]) == sorted(d for d in ss if root[d] == d)
    # no passage of the benchmark is left, and nothing else went
    wins = set()
    for i in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect():
        w = words(i.text)
        wins |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    lens = {len(w) for w in wins}

    def dirty(t):
        w = words(t)
        return any(tuple(w[k : k + m]) in wins for m in lens for k in range(len(w) - m + 1))

    assert sorted(r.doc_id for r in rows[3]) == sorted(r.doc_id for r in rows[2] if not dirty(r.text))
    # shards hold the mixed documents
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=token_shards.PATTERN, mergeable_ranks=token_shards.vocabulary(), special_tokens={})
    want = sorted(len(enc.encode_ordinary(r.text)) + 1 for r in rows[4])
    assert sum(r.n_tokens for r in rows[5]) == sum(want)
    held = Counter(d for r in rows[5] for d in r.doc_ids)
    assert held == sum((Counter({r.doc_id: -(-(len(enc.encode_ordinary(r.text)) + 1) // token_shards.LENGTH)}) for r in rows[4]), Counter())
    assert sum(r.n_records for r in rows[5]) == sum(held.values()) and sorted(r.shard for r in rows[5]) == list(range(len(rows[5])))
    assert start.count() > len(rows[3])


def test_run_and_empty(spark, stages, tmp_path):
    sf = "/root/testdata/sf0.001"
    key = lambda r: (r.shard, r.n_records, r.n_tokens, r.sha256)
    assert sorted(map(key, corpus_pipeline.run(spark, sf).collect())) == sorted(map(key, stages[-1].collect()))
    stages[0].limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
