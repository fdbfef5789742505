import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.llm import quality

WS = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t):
    t = t or ""
    w = WS.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    rep = {i + j for i, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WS.search(x)]
    return len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), len(rep)


TEXTS = [None, "", " \n\t", "a", "a b", "a b c a b c", "x\x0bx x x x x x", "é#ü $$ |\n\né#ü $$ |\n x", "l1\nl1\n\n\nl1 \nl1", "a b c d", "w " * 300, "\r\na\r\nb\r\na\r\n", "one two three four\n" * 400 + " ".join(f"x{i}" for i in range(3000))]


def test_counts(spark):
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("ab \n#") for _ in range(rnd.randint(0, 120))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, None, "s", "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words string")
    got = {r.doc_id: r for r in quality.assess(df).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in quality.STATS) == counts(t), t
        n, rep = got[i].n_words, got[i].n_repeat_words
        assert got[i].base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (got[i].base_failed and got[i].kept)


def corpus():
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 8))) for _ in range(int(60 * 2 ** rnd.random()))]
        if i % 20 == 0:
            words = [w + "$#" for w in words]
        rows.append((i, " ".join(words), "en" if i % 2 else None, "hot" if i % 3 else "cold"))
    return rows


def quantile(v, share):
    b = np.sort(np.floor(np.array(v) * quality.BINS).astype(int))
    return b[int(np.ceil(len(b) * share)) - 1]


def mcd(x):
    """Centre and scatter of least determinant, in numpy."""
    floor = np.diag(np.array(quality.FLOORS) ** 2)
    logdet = lambda c: np.linalg.slogdet(c + floor)[1]

    def from_nearest(ld):
        near = np.floor(ld * quality.BINS) <= quantile(ld, quality.H)
        return x[near].mean(0), quality.CONSISTENCY * np.cov(x[near].T, bias=True).reshape(5, 5)

    def step(m, c):
        return from_nearest(np.log1p(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + floor), x - m)))

    mid = np.array([(quantile(x[:, j], 0.5) + 0.5) / quality.BINS for j in range(5)])
    dev = np.array([quantile(np.abs(x[:, j] - mid[j]), 0.5) * 1.4826 / quality.BINS for j in range(5)])
    z = np.abs(x - mid) / np.sqrt(dev**2 + np.array(quality.FLOORS) ** 2)
    tried = []
    for first in ((z * z).sum(1), z.sum(1), z.max(1)):
        m, c = from_nearest(np.log1p(first))
        for _ in range(quality.TRIAL):
            m, c = step(m, c)
        tried.append((m, c))
    m, c = min(tried, key=lambda t: logdet(t[1]))
    while True:
        m2, c2 = step(m, c)
        if not logdet(c2) < logdet(c) - quality.FALL:
            return m, c
        m, c = m2, c2


def shrunk(n, own, parent):
    w = n / (n + quality.SHRINK)
    gap = own[0] - parent[0]
    return w * own[0] + (1 - w) * parent[0], w * own[1] + (1 - w) * parent[1] + w * (1 - w) * np.outer(gap, gap)


def test_outliers_match_brute_force(spark):
    rows = corpus() + [(900 + i, t, "xx", "rare") for i, (_, t, *_) in enumerate(corpus()[1:4])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.assess(df).collect()}
    groups, langs, every = {}, {}, []
    for i, t, lang, source in rows:
        n, chars, sym, again, rep = counts(t)
        v = [np.log(n), np.log(chars / n), np.sqrt(sym / n), np.sqrt(rep / n), 0.0]
        groups.setdefault((lang, source), []).append((i, v))
        langs.setdefault(lang, []).append(v)
        every.append(v)
    top = mcd(np.array(every))
    parent = {k: shrunk(len(v), mcd(np.array(v)), top) for k, v in langs.items()}
    floor = np.diag(np.array(quality.FLOORS) ** 2)
    for (lang, _), members in groups.items():
        x = np.array([m[1] for m in members])
        m, c = shrunk(len(x), mcd(x), parent[lang])
        d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + floor), x - m)
        for (i, _), d in zip(members, d2):
            assert got[i].distance2 == pytest.approx(d, rel=1e-6)
            assert got[i].kept == (d <= quality.CUTOFF)
    assert not any(got[i].kept for i in range(0, 400, 20)) and sum(r.kept for r in got.values()) == 383


def test_stage_keeps_columns_and_repeats(spark):
    rows = corpus()
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string, source string").withColumn("n_words", F.lit("x")).withColumn("__y0", F.lit(1))
    out = quality.keep_good(df)
    assert out.columns == df.columns and out.count() == 384
    assert quality.keep_good(df.limit(0)).count() == 0 and quality.assess(df.limit(0)).count() == 0
