import hashlib
import random

import pytest

from helixmill.llm import suffix_dedup


def brute(rows, length):
    """Rows (doc_id, text) in their order; texts may be None."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] if rows[i][0] is not None else 0, i))
    seen, out = set(), {}
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = [False] * len(raw)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out[rows[i][0]] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    return {r[0]: tuple(r)[1:] for r in suffix_dedup.remove(df, with_text=False, **kw).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_brute_force(spark, seed):
    rnd = random.Random(seed)
    alphabet = ["ab", "abé", "abcdefghij "][seed]
    base = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 90))) for _ in range(8)]
    rows = []
    for i in range(60):
        t = "".join(rnd.choice(base) for _ in range(rnd.randint(0, 5)))
        t = "".join(rnd.choice(alphabet) if rnd.random() < 0.02 else c for c in t)
        rows.append((i * 7 % 61 if i else None, t if i % 17 else None, "x"))
    rows += [(100, "", "x"), (101, "a" * 500, "x"), (102, "a" * 40, "y"), (103, rows[5][1], "z"), (104, "ab" * 120, "z")]
    for length, k in ((20, 10), (30, 11)):
        assert run(spark, rows, length=length, k=k) == brute([r[:2] for r in rows], length)


def test_repeated_rows_and_empty(spark):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefgh") for _ in range(300))
    got = suffix_dedup.remove(spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 300)]
    assert suffix_dedup.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_production_lengths(spark):
    """Strings of 100 bytes: periodic texts of 100 to 149 bytes, copies, passages and a long text against brute force."""
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghijklmno") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [prose(n) for n in (14, 18, 25, 60)]
    rows = [(0, "a" * 120, ""), (1, "spam " * 24, ""), (2, "xyz" * 45, ""), (3, "a" * 149, ""), (4, "spam " * 20, ""), (5, "ab" * 70, "")]
    for i in range(6, 50):
        rows.append((i, " ".join([prose(rnd.randint(0, 40)), rnd.choice(shared), prose(rnd.randint(0, 40))]) if i % 4 else rnd.choice(rows)[1], ""))
    rows += [(60, prose(6000) + shared[3] + prose(500), ""), (61, shared[0][:99], ""), (62, shared[3][:100], "")]
    rnd.shuffle(rows)
    assert run(spark, rows) == brute([r[:2] for r in rows], 100)
