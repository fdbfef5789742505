import random
import re

import pytest

from helixmill.llm import graph, ngram_join
from helixmill.llm.common import Stash


def sets(text, n=5):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def brute(rows):
    ss = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ss[i] and ss[j] and 100 * len(ss[i] & ss[j]) >= 75 * len(ss[i] | ss[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names.setdefault(find(i), []).append(d)
    return sorted(((d, len(ss[i]), d if not ss[i] else min(names.get(find(i), [None]), key=lambda x: (x is None, x))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    passage = [rnd.choice(words) for _ in range(30)]
    bases = [[rnd.choice(words) for _ in range(rnd.randint(1, 90))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, " \t\x0b"), (3, "one"), (4, "ONE"), (5, "a b c d"), (6, "a B c d"), (7, "a b c d e"), (None, "x y z"), (None, "x y z"), (8, "É y"), (9, "é y")]
    for i in range(10, n):
        w = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        if rnd.random() < 0.3:
            w += passage
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(w)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,t,many,size,chunk", [(1, 32, 1_000_000, 1 << 24, 200_000), (2, 2, 1_000_000, 8, 200_000), (3, 2, 100, 1 << 24, 50)])
def test_brute_force(spark, monkeypatch, seed, t, many, size, chunk):
    """Few and many heavy shingles; buckets for few bytes each; texts of more shingles than a task holds at a time."""
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", size)
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "T", t)
    monkeypatch.setattr(ngram_join, "MAX_HEAVY", many)
    rows = corpus(seed, 250)
    rows += rows[20:25] + [(None, t) for _, t in rows[30:60]]  # repeated rows, and many without a key
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, gid string")
    got = sorted((tuple(r) for r in ngram_join.linked_classes(df).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert ngram_join.linked_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 4), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Stash(spark)).collect()}
    assert got == {x: find(x) for x in parent}


def test_parity_bound():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m in ((3, 5), (400, 700), (3000, 100), (9000, 8000)):
        pool = rng.integers(0, 2**63, 12000).astype(np.uint64)
        x, y = np.unique(rng.choice(pool, n)), np.unique(rng.choice(pool, m))
        far = len(np.setxor1d(x, y))
        assert ngram_join.apart(ngram_join.parity(x), ngram_join.parity(y)) <= far
        assert ngram_join.apart(ngram_join.parity(x), ngram_join.parity(x)) == 0
    x, y = (np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64)) for _ in "xy")
    assert ngram_join.apart(ngram_join.parity(x), ngram_join.parity(y)) > 3500
