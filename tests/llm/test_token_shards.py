import hashlib
import os
import random

import numpy as np
import pytest

from helixmill.llm import token_shards as ts


@pytest.mark.parametrize("total", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(total):
    out = ts.permute(np.arange(total), total, 9)
    assert sorted(out) == list(range(total))
    if total > 60:
        assert (out != np.arange(total)).any() and (out != ts.permute(np.arange(total), total, 10)).any()


def test_round_trip(spark, tmp_path):
    import tiktoken

    rnd = random.Random(1)
    rows = [(0, None), (1, ""), (2, " \n\n x"), (None, "no key"), (3, "é😀 <|endoftext|> long " * 900)] + [(i, " ".join(rnd.choice(["the", "words", "of", "Ünder", "42"]) for _ in range(rnd.randint(1, 300)))) for i in range(4, 60)]
    rows += rows[10:12]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, slot string").repartition(3)
    recs = ts.records(df, length=32, rows=50)
    got = recs.collect()
    total = len(got)
    assert sorted(r.slot for r in got) == list(range(total))
    assert all(r.shard == r.slot // 50 and r.offset == r.slot % 50 * 64 and len(r.ids) == 64 for r in got)
    manifest = ts.build(df, where=f"file://{tmp_path}/out", length=32, rows=50).collect()
    assert sum(m.n_records for m in manifest) == total and [m.shard for m in sorted(manifest)] == list(range(-(-total // 50)))
    for m in manifest:
        raw = (tmp_path / "out" / m.file).read_bytes()
        mine = sorted((r for r in got if r.shard == m.shard), key=lambda r: r.slot)
        assert len(raw) == m.n_bytes == 64 * m.n_records and hashlib.sha256(raw).hexdigest() == m.sha256 and m.first_slot == 50 * m.shard
        assert m["keys"] == [r.doc_id for r in mine] and m.n_tokens == sum(r.n_tokens for r in mine)
    assert not [f for f in os.listdir(tmp_path / "out") if f.startswith(".part-") and not f.endswith(".crc")]
    back = list(ts.read_slots(f"file://{tmp_path}/out", 0, total, length=32, rows=50))
    by = {r.slot: r for r in got}
    assert all(bytes(by[i].ids) == back[i].tobytes() for i in range(total))
    assert [x.tolist() for x in ts.read_slots(f"file://{tmp_path}/out", 45, 60, length=32, rows=50)] == [x.tolist() for x in back[45:60]]
    vocab = ts.vocabulary()
    enc = tiktoken.Encoding("t", pat_str=ts.PATTERN, mergeable_ranks=vocab, special_tokens={})
    texts = {}
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.seq, r.slot)):
        texts.setdefault(r.doc_id, {}).setdefault(r.seq, back[r.slot][: r.n_tokens].tolist())
    for d, t in rows:
        ids = [x for s in sorted(texts[d]) for x in texts[d][s]]
        assert ids[-1] == 50256 and enc.decode(ids[:-1]) == (t or "")


def feistel(i, total, key):
    """The permutation, one number at a time."""
    half = max(1, -(-max(total - 1, 1).bit_length() // 2))
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") | 1 for r in range(ts.ROUNDS)]
    while True:
        left, right = i >> half, i % 2**half
        for k in keys:
            f = (right + (k >> 32)) * k % 2**64
            f ^= f >> 29
            f = f * 0xBF58476D1CE4E5B9 % 2**64
            left, right = right, left ^ (f >> 32) % 2**half
        i = left << half | right
        if i < total:
            return i


def test_order_is_free_of_layout(spark):
    """Every slot against brute force, from inputs and shuffles of several layouts."""
    rows = [(i if i % 7 else None, f"text {i} " * (i % 90)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    for parts, shuffled in ((2, 3), (5, 8), (11, 17)):
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        got = ts.records(df.repartition(parts), length=16, rows=40).collect()
        seen.append({r.slot: (r.doc_id, r.seq, bytes(r.ids)) for r in got})
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(got)
    total = len(got)
    by_hash = spark.createDataFrame(rows, "k long, t string").selectExpr("k", "t", f"shiftrightunsigned(xxhash64({ts.KEY}, k, t, t is null), 4) as h").collect()
    n_of = {}
    for r in got:
        n_of.setdefault(r.doc_id, []).append(r.seq)
    index = 0
    for r in sorted(by_hash, key=lambda r: r.h):
        seq = 0
        while True:
            slot = feistel(index, total, ts.KEY)
            assert seen[0][slot][:2] == (r.k, seq)
            index, seq = index + 1, seq + 1
            if seen[0][slot][2][-2:] == (50256).to_bytes(2, "little"):
                break
    assert index == total


def test_empty(spark):
    assert ts.build(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert ts.records(spark.createDataFrame([], "doc_id long, text string")).count() == 0
