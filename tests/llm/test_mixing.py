import hashlib
import random
import re
from collections import Counter, defaultdict

from helixmill.llm import mixing


def goals(rows):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = float(sum(size.values())), set(names), {}
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    return size, target


def corpus(n=300):
    rnd = random.Random(1)
    src = ["b", "a", None, "é", "hot", "zero", "tiny"]
    rows = [(i, " ".join("w" for _ in range(rnd.choice([0, 3, 20, 90]))), rnd.choice(src + ["hot"] * 6)) for i in range(n)]
    rows = [(i, "" if s == "zero" else t, s) for i, t, s in rows if s != "tiny"] + [(1000, None, "b"), (1001, "a b c", "tiny"), (None, "x\ty", "a")]
    return rows + rows[:4]


def test_mix(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, target string")
    got = mixing.mix(df, shards=5).collect()
    size, target = goals(rows)
    assert len(got) == len(rows)
    of, taken, by_shard = {r[0]: r[2] for r in rows}, Counter(), Counter()
    laps = defaultdict(list)
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-3
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(p["words"] for p in r.pieces)
        taken[s] += r.taken
        for p in r.pieces:
            by_shard[p["shard"]] += p["words"]
            assert 0 < p["words"] <= r.size and 0 <= p["shard"] < 5
        laps[s].append(r.taken / r.size if r.size else None)
    for s in target:
        assert abs(taken[s] - target[s]) <= 1
    assert sum(by_shard.values()) == sum(taken.values())
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, mixing.mix(df.repartition(7), shards=5).collect())) == sorted(map(key, got))


def test_tree_adds_up():
    quotas = [1000, 10, 0, 333]
    for shards in (1, 2, 7, 64):
        out = mixing.shard_quotas(quotas, shards)
        assert len(out) == shards and out.min() >= 0 and out.sum(axis=0).tolist() == quotas
        totals = out.sum(axis=1)
        assert totals.max() - totals.min() <= shards


def test_pieces_follow_the_tree(spark, monkeypatch):
    """Each piece's shard against brute force from the quotas; without the tree's blocks nothing is taken."""
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = [(i, " ".join("w" * (i % 40)), f"s{i % 3}" if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, shards=9).collect()
    size, target = goals(rows)
    names = sorted(size, key=lambda s: (s is None, s or ""))
    quotas = [-(-round(target[s]) // 16) for s in names]
    cuts = mixing.shard_quotas(quotas, 9).cumsum(axis=0)
    order = sorted(got, key=lambda r: hashlib.md5(f"{mixing.SEED}:{r.doc_id}".encode()).hexdigest()[:15])
    of = {r[0]: r[2] for r in rows}
    shards = set()
    for i, s in enumerate(names):
        f, c = mixing._order_of_blocks(quotas[i], mixing.np.random.default_rng([mixing.SEED, i]))
        at = 0
        for r in (r for r in order if of[r.doc_id] == s):
            want = []
            for lap in range(4):
                start = lap * size[s] + at
                if r.size and start < round(target[s]):
                    block = (start // 16 * f + c) % quotas[i]
                    want.append((int((cuts[:, i] <= block).sum()), lap, min(r.size, round(target[s]) - start)))
            assert [tuple(p) for p in r.pieces] == want and r.taken == sum(x[2] for x in want)
            shards |= {x[0] for x in want}
            at += r.size
    assert shards == set(range(9))
    monkeypatch.setattr(mixing, "shard_quotas", lambda q, n, seed: mixing.np.zeros((n, len(q)), int))
    assert {r.taken for r in mixing.mix(df, shards=9).collect()} == {0}


def test_stage(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string")
    out = mixing.drawn_documents(df, shards=4)
    assert out.columns == df.columns
    n, words = Counter(), Counter()
    for r in out.collect():
        n[r.doc_id] += 1
        words[r.doc_id] += len(r.text.split())
    assert max(n[r[0]] for r in rows if rows.count(r) == 1) <= 3
    taken = Counter()
    for r in mixing.mix(df, shards=4).collect():
        taken[r.doc_id] += r.taken
    assert +taken == words
    assert mixing.drawn_documents(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def test_first_words(spark):
    from pyspark.sql import functions as F

    rows = [("a b\tc", 2, "a b\t"), ("\n a  b c", 1, "\n a  "), ("a", 1, "a"), ("x y " * 3000, 5999, "x y " * 2999 + "x ")]
    got = spark.createDataFrame(rows, "t string, n int, want string").select(mixing.first_words(F.col("t"), F.col("n")).alias("x"), "want").collect()
    assert all(r.x == r.want for r in got)
