import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixmill.config import Config
from helixmill.functions import scores, seq, thermo

DNA = st.lists(st.text("ACGT", min_size=2, max_size=25), min_size=5, max_size=30)
RELAXED = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
COMP = str.maketrans("ACGT", "TGCA")


def rows(spark, words, **columns):
    df = spark.createDataFrame([(w,) for w in words], "s string")
    return df.select("s", *[c.alias(n) for n, c in columns.items()]).collect()


def one(spark, word, column):
    return spark.createDataFrame([(word,)], "s string").select(column.alias("x")).first().x


@RELAXED
@given(DNA)
def test_sequence_functions(spark, words):
    s = F.col("s")
    for r in rows(spark, words, rc=seq.reverse_complement(s), can=seq.canonical(s), gc=seq.gc_content(s), run=seq.longest_run(s, "A"), km=seq.kmers(s, 4), var=seq.mismatch_variants(s), lc=seq.linguistic_complexity(s)):
        w = r.s
        rc = w.translate(COMP)[::-1]
        assert r.rc == rc and r.can == min(w, rc) and r.gc == pytest.approx((w.count("G") + w.count("C")) / len(w))
        assert r.run == max(map(len, "".join(c if c == "A" else " " for c in w).split()), default=0)
        assert r.km == [w[i : i + 4] for i in range(len(w) - 3)]
        assert len(r["var"]) == len(set(r["var"])) == 3 * len(w) and all(sum(a != b for a, b in zip(v, w)) == 1 for v in r["var"])
        subs = {w[i:j] for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        assert r.lc == pytest.approx(len(subs) / (len(w) * (len(w) + 1) / 2))


@RELAXED
@given(DNA)
def test_thermodynamics(spark, words):
    s = F.col("s")
    for r in rows(spark, words, h=thermo.enthalpy(s), e=thermo.entropy(s), tm=thermo.tm_salt(s), more=thermo.tm_salt(s, na=100.0), dg=thermo.free_energy(s), v=thermo.vendored_tm(s), strict=thermo.tm_basic(s, strict=True), strict_rc=thermo.tm_basic(seq.reverse_complement(s), strict=True)):
        w = r.s
        h = 0.2 + sum(thermo.ENTHALPY[w[i : i + 2]] for i in range(len(w) - 1)) + 2.2 * ((w[0] in "AT") + (w[-1] in "AT"))
        e = -5.7 + sum(thermo.ENTROPY[w[i : i + 2]] for i in range(len(w) - 1)) + 6.9 * ((w[0] in "AT") + (w[-1] in "AT")) - 1.4 * (w == w.translate(COMP)[::-1])
        assert r.h == pytest.approx(h) and r.e == pytest.approx(e) and r.dg == pytest.approx(h - 310.15 * e / 1000)
        assert all(math.isfinite(x) for x in (r.tm, r.v)) and r.v >= 0
        assert r.strict == pytest.approx(r.strict_rc, abs=1e-6)
        if len(w) > 6 and h < -20:
            assert r.more > r.tm


def test_dimers_and_rules(spark):
    s = F.col("s")
    assert one(spark, "ACGTACGT", seq.is_dimer(s, F.lit("ACGTACGT"), 3)) is True
    assert one(spark, "AAAAAA", seq.is_dimer(s, F.lit("AAAAAA"), 3)) is False
    assert one(spark, "ATATATATAT", seq.has_dinucleotide_repeat(s)) is True
    assert one(spark, "ATATATATAC", seq.has_dinucleotide_repeat(s)) is False
    assert one(spark, "GGGGGA", seq.has_homopolymer(s, 5)) is True
    assert one(spark, "ACGTT", seq.longest_common_substring(s, F.lit("CCGTA"), 8)) == 3
    assert one(spark, "ACGT", seq.hamming(s, F.lit("ACCTT"))) == 2


def test_scores(spark):
    x = F.length("s").cast("double")
    assert one(spark, "A" * 8, scores.rating(x, (10.0, 5.0, 3.0, 1.0))) == pytest.approx(0.75 + 0.25 * 3 / 5)
    assert one(spark, "A" * 30, scores.rating(x, (3.0, 5.0, 8.0, 12.0), True)) == 0
    assert one(spark, "A" * 20, scores.fold(x)) == 4.0
    assert one(spark, "A" * 12, scores.scaled_threshold(1.0, F.length("s"))) == pytest.approx(1 / 16)


def test_config():
    assert Config.for_polymerase("bst").max_k == 25
    with pytest.raises(ValueError):
        Config(min_k=9, max_k=8)
    with pytest.raises(ValueError):
        Config(polymerase="none", gc_min=0.9)
