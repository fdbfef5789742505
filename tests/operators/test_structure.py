from helixmill.operators import structure
from helixmill.sources.registry import Registry


def test_heterodimer(spark):
    e, tm, n = structure.heterodimer("ACGTACGTAC", "GTACGTACGT")
    assert n == 10 and e < -9
    assert structure.heterodimer("AAAAAA", "AAAAAA") == (0.0, 0.0, 0)
    e2, _, n2 = structure.heterodimer("ACGTACGTAC", "GTACGAACGT")
    assert e < e2 < 0 and n2 < 10
    rows = structure.heterodimers(spark.createDataFrame([("ACGTACGTAC", "GTACGTACGT"), ("AAAA", "AAAA")], "a string, b string")).collect()
    assert rows[0].severity > 0 and rows[1].severity == 0
    p = spark.createDataFrame([("GCGCGCGCGCGCGC",), ("AAAAAAAA",)], "primer string")
    assert [r.primer for r in structure.stable(p).collect()] == ["AAAAAAAA"]


def test_registry(spark, tmp_path):
    g = Registry(spark, f"{tmp_path}/reg")
    assert g.list().count() == 0 and not g.remove("x")
    g.add("Human", "/h.fa", "background", 3)
    g.add("ecoli", "/e.fa", "target", 4)
    g.add("Human", "/h2.fa", "background", 5)
    assert g.get("Human").path == "/h2.fa" and [r.name for r in g.search("HUM").collect()] == ["Human"]
    assert g.remove("Human") and g.get("Human") is None and g.list().count() == 1
