import random
import re

import regex

from helixmill.llm import surrogates as sg

ROWS = [
    (0, None), (1, ""), (2, "nothing here 12345 or 1.2.3 at all"),
    (3, "mail ann.lee@mail.example.com, ANN.LEE@MAIL.EXAMPLE.COM or bob@x.org."),
    (4, "call +1 (743) 555-3824 or +1 743 555 3824 or (743) 555-3824"),
    (5, "card 4111111111111111, 4111-1111-1111-1111 and 4785380592391140$$$"),
    (6, "ip 10.1.2.3 and 152.143.123.131### but not 999.1.2.3"),
    (7, "ssn 123-45-6789; token 24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
    (8, "Mrs. Anna Schmidt met Herr Schmidt. Schmidt and Anna left. Господин Иванов тоже, Иванов."),
    (None, "bob@x.org"), (9, "bob@x.org " * 3000), (9, "bob@x.org " * 3000),
]


def luhn(d):
    return sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(int(c) for c in reversed(d))) % 10


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, __any string")
    out = sg.replace(df)
    assert out.columns[:3] == df.columns
    return out.collect()


def test_cases(spark):
    out = run(spark, ROWS)
    t = {r.doc_id: r.text for r in out}
    assert t[0] is None and t[1] == "" and t[2] == ROWS[2][1] and len(out) == len(ROWS)
    a, b, c = re.findall(r"[^ ,]+@[^ ,]+[a-zA-Z]", t[3])
    assert b == a.upper() and c != a and "lee" not in t[3].lower() and c == t[None] and t[9] == (c + " ") * 3000
    p = re.match(r"call (\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3} \d{3} \d{4}) or (\(\d{3}\) \d{3}-\d{4})", t[4])
    d = [re.sub(r"\D", "", x) for x in p.groups()]
    assert d[0] == d[1] and d[0][1:] != "7435553824"
    x, y, z = re.match(r"card (\d{16}), (\d{4}-\d{4}-\d{4}-\d{4}) and (\d{16})\$\$\$", t[5]).groups()
    assert x == y.replace("-", "") != "4111111111111111" and x[0] == "4" and luhn(x) == 0 and luhn(z) == luhn("4785380592391140")
    assert t[6].startswith("ip 10.") and "152.143.123.131" not in t[6] and "999.1.2.3" in t[6]
    assert re.search(r"ssn \d{3}-\d\d-\d{4};", t[7]) and "123-45-6789" not in t[7] and "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" in t[7]
    m = re.match(r"Mrs. (\w+) (\w+) met Herr (\w+). (\w+) and (\w+) left. Господин ([а-яА-Я]+) тоже, ([а-яА-Я]+).", t[8])
    g, f1, f2, f3, g2, r1, r2 = m.groups()
    assert f1 == f2 == f3 != "Schmidt" and g == g2 and g != "Anna" and g.endswith("a") and r1 == r2 != "Иванов"


def norms(kind, word):
    digits = re.sub(r"\D", "", word)
    return word.lower() if kind in ("email", "ip6", "given", "family") else word if kind == "ip" else digits[-10:] if kind == "phone" else digits


def test_probes(spark):
    rows = [
        (1, "Mrs Kim Lee met Dr Kim Lee and Kim. +1 (743) 555-3824 or (743) 555-3824, KIM"), (2, "Mr White saw White Snow"),
        (3, "Dr. Anne-Marie O'Brien's dog; O'Brien left, Anne-Marie too."), (4, "fe80::1 FE80::AB 2001:db8:0:0:0:0:0:1 at 12:30:45 std::min"), (5, "Dr Kim Park"),
    ]
    t = {r.doc_id: r.text for r in run(spark, rows)}
    m = re.fullmatch(r"Mrs (\w+) (\w+) met Dr (\w+) (\w+) and (\w+)\. \+1 (.*) or (.*), (\w+)", t[1])
    assert m[1] == m[3] == m[5] == m[8].capitalize() and m[2] == m[4] and m[6] == m[7] != "(743) 555-3824" and "kim" not in t[1].lower()
    assert t[5].split()[1] == m[1]  # the same person's name in another document, though its form of address tells no gender
    a, b = re.fullmatch(r"Mr (\w+) saw (\w+) Snow", t[2]).groups()
    assert a == b != "White"
    g, f, f2, g2 = re.fullmatch(r"Dr\. (\w+-\w+) (\w+)'s dog; (\w+) left, (\w+-\w+) too\.", t[3]).groups()
    assert g == g2 and f == f2 and "Brien" not in t[3] and "Marie" not in t[3]
    x, y, z = t[4].split()[:3]
    assert x.startswith("fe80::") and x != "fe80::1" and y.startswith("FE80::") and y == y.upper() and z.startswith("2001:") and t[4].endswith(" at 12:30:45 std::min")


def test_many_names_end_and_stay_apart(spark):
    """More entities than a fixed list holds: 5,000 given names and 300,000 family names."""
    from pyspark.sql import functions as F

    from helixmill.llm.common import Stash

    letters = F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abcdefghij")
    given = spark.range(5000).select(F.lit("given").alias("kind"), F.concat(F.lit("qu"), letters).alias("norm"), F.lit("f").alias("gender"))
    family = spark.range(300000).select(F.lit("family").alias("kind"), F.concat(F.lit("xy"), letters).alias("norm"), F.lit("n").alias("gender"))
    taken = spark.range(1).select(F.lit("family").alias("kind"), sg.surrogate(F.lit("family"), F.lit("xyaaaaaa"), F.lit("n"), F.lit(0)).alias("norm"), F.lit("n").alias("gender"))
    ents = given.unionByName(family).unionByName(taken).withColumn("mixed", F.lit(False))
    out = sg.counters(ents, Stash(spark)).withColumn("s", sg.surrogate(F.col("kind"), F.col("norm"), F.col("gender"), F.col("counter"))).cache()
    n, d, c = out.agg(F.count("*"), F.countDistinct("s"), F.max("counter")).first()
    assert n == d == 305001 and 0 < c < 10
    assert out.join(out.select(F.col("norm").alias("s")), "s").count() == 0
    out.unpersist()


def test_numbers_are_permuted(spark):
    from pyspark.sql import functions as F

    d = spark.range(10000).select(F.concat(F.lit("7"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("norm")).select("norm", sg.surrogate(F.lit("phone"), F.col("norm"), F.lit("n"), F.lit(0)).alias("s")).collect()
    assert {r.s for r in d} == {r.norm for r in d}  # a bijection of the whole space
    ips = spark.range(3000).select(F.concat(F.lit("10.0."), (F.col("id") / 256).cast("int").cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("norm"))
    got = ips.select(sg.surrogate(F.lit("ip"), F.col("norm"), F.lit("n"), F.lit(0)).alias("s")).collect()
    assert len({r.s for r in got}) == 3000 and all(re.fullmatch(r"10(\.\d{1,3}){3}", r.s) and max(map(int, r.s.split("."))) < 256 for r in got)


def test_against_brute_force(spark):
    """Mentions by another regular expression engine; surrogates are a function of entities, and one to one."""
    rnd = random.Random(3)
    people = [rnd.choice(["Mrs", "Mr", "Dr"]) + " " + rnd.choice(["Ada", "Bob", "Cyr"]) + " " + rnd.choice(["Fox", "Gale", "Hull"]) for _ in range(12)]
    items = people + [f"{a}@b{i}.org" for i, a in enumerate("xyz")] + [f"10.0.0.{i}" for i in range(6)] + [f"900-00-{1000 + i}" for i in range(6)] + [f"(900) 555-{1000 + i}" for i in range(6)] + ["4111 1111 1111 1111"]
    rows = [(i, " and ".join(rnd.choice(items + ["plain words", "ordinary"]) for _ in range(rnd.randint(0, 12)))) for i in range(80)]
    rows += rows[:3]
    got = run(spark, rows)
    whole = regex.compile(sg.ANY)
    seen, back = {}, {}
    for r in got:
        text = dict(rows)[r.doc_id]
        spans = list(whole.finditer(text))
        of_names = [x for x in r["__found"] if x.kind in ("given", "family")]
        assert len(r["__found"]) - len(of_names) // 2 == len(spans)
        at = whole.split(text)
        assert [p for p in whole.split(r.text)] == at or len(at) == len(spans) + 1
        for x in r["__found"]:
            e = (x.kind, norms(x.kind, x.word))
            s = (("name" if x.kind in ("given", "family") else x.kind), norms(x.kind, x.new))
            assert seen.setdefault(e, s) == s and back.setdefault(s, e) == e and x.word.lower() not in x.new.lower()
    other = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.text for r in sg.replace(other, secret="another").collect()} != {r.text for r in got}


def test_odd_columns_and_empty(spark):
    assert sg.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    names = ["key", "doc", "t", "h", "some", "odd", "ms", "names", "__found2", "new"]
    df = spark.createDataFrame([(1, "Mr Fox", *["v"] * len(names))], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = sg.replace(df).collect()
    assert len(out) == 1 and out[0].odd == "v" and "Fox" not in out[0].text
