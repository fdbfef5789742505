import hashlib
import random
import re

import duckdb
import pytest

from helixmill.llm import decontaminate


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, window=10):
    wins = {}
    for k, t in items:
        w = words(t)
        for i in range(max(len(w) - window + 1, 1 if w else 0)):
            wins.setdefault(tuple(w[i : i + window]), set()).add(str(k))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    v = ["the", "of", "a"] * 5 + ["w%d" % i for i in range(40)] + ["É", "ß7"]
    items = [(i, " ".join(rnd.choice(v) for _ in range(rnd.choice([0, 1, 3, 5, 7, 10, 12, 30])))) for i in range(30)] + [(77, None), (78, "The, OF... a!"), (79, "the of a")]
    docs = [(0, None), (1, ""), (2, "..."), (None, items[5][1])]
    for i in range(3, 80):
        w = [rnd.choice(v) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            x = (rnd.choice(items)[1] or "").split()
            s = rnd.randint(0, max(0, len(x) - 10))
            at = rnd.randint(0, len(w))
            w[at:at] = x[s : s + rnd.randint(5, 20)]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(w)))
    return docs + docs[10:12], items


@pytest.mark.parametrize("seed,small", [(1, False), (2, True)])
def test_brute_force(spark, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs, items = corpus(seed)
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, pos int")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc string")
    got = sorted((tuple(r) for r in decontaminate.scan(d, i).collect()), key=str)
    assert got == brute(docs, items)
    clean = decontaminate.drop_contaminated(d, i)
    assert clean.columns == d.columns and clean.count() == sum(not r[-1] for r in got)
    assert sum(r[-1] for r in decontaminate.scan(d, i.limit(0)).collect()) == 0 and decontaminate.scan(d.limit(0), i).count() == 0


def test_oracle(spark):
    docs, items = corpus(3)
    docs = [r for r in docs if r[0] is not None][:-2]
    c = duckdb.connect()
    c.execute("create table documents(doc_id bigint, text varchar); create table benchmark(item_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", docs)
    c.executemany("insert into benchmark values (?, ?)", items)
    assert sorted(map(tuple, c.sql(decontaminate.ORACLE).fetchall()), key=str) == brute(docs, items)


def test_long_texts(spark):
    """A text of 30,000 words with items at its start, middle and end, twice; and an item that is longer than any text."""
    rnd = random.Random(9)
    fill = lambda n: [f"f{rnd.randint(0, 3000)}" for _ in range(n)]
    item = [f"q{i}" for i in range(25)]
    long_ = " ".join(item + fill(15000) + item[3:18] + fill(15000) + item[-10:])
    docs = [(1, long_), (1, long_), (2, " ".join(item[:9])), (3, " ".join(fill(200)))]
    items = [(5, " ".join(item)), (6, " ".join(fill(40000)))]
    got = sorted((tuple(r) for r in decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()), key=str)
    assert got == brute(docs, items) and got[0][2] == 50
