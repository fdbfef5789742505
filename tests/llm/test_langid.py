import random

from helixmill.llm import langid

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "en er ch ei ie sch ung ver ge lich".split(), "fr": "le de ent que ou eau é tion aux re".split(), "es": "de la que os el ción ar as ñ ado".split(), "xx": "ka zu mo ti".split()}


def corpus(n, seed=1):
    rnd = random.Random(seed)
    rows = [(0, None, "en"), (1, "", "fr"), (2, "12 !! 34", "de"), (None, "the end", "en")]
    for i in range(3, n):
        lang = rnd.choice(list(SYLLABLES))
        text = " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(5, 60)))
        rows.append((i, text, None if i % 10 == 0 else lang))
    return rows


def test_held_out_accuracy_and_cases(spark):
    rows = corpus(600)
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(got) == len(rows)
    for i in (0, 1, 2):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[None].held_out is False and got[None].lang_pred in SYLLABLES
    test = [r for r in rows[4:] if got[r[0]].held_out and r[2]]
    assert len(test) > 60
    assert sum(got[r[0]].lang_pred == r[2] for r in test) / len(test) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    again = {r.doc_id: r for r in langid.identify(df.repartition(3)).collect()}
    assert again == got


def test_few_labels(spark):
    df = spark.createDataFrame([(1, "abc", None), (3, "abd", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(df).collect()} == {"und"}
    one = spark.createDataFrame([(i, "abc", "fr") for i in range(9)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(one).collect()} == {("fr", 1.0)}
    assert langid.identify(one.limit(0)).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    """Many languages, one of them hot, and repeated rows: training never gathers more than the sample."""
    taken = []
    monkeypatch.setattr(langid, "Model", lambda x, labels: taken.append(labels))
    rows = [(i, f"text of {i}", f"l{i % 200}" if i % 3 else "hot") for i in range(6000)] + [(7, "text of 7", "l7")] * 50
    langid.fit(spark.createDataFrame(rows, "key long, text string, lang string"))
    assert len(taken[0]) <= langid.SAMPLE and len(set(taken[0])) == 201 and max(map(taken[0].count, set(taken[0]))) == langid.SAMPLE // 201
    monkeypatch.setattr(langid, "SAMPLE", 100)
    langid.fit(spark.createDataFrame(rows, "key long, text string, lang string"))
    assert len(taken[1]) == 100


def test_ties_and_long_texts(spark):
    rows = [(i, "der die das und nicht " * (3000 if i == 9 else 3), "de" if i % 2 else "nl") for i in range(60)] * 2
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 120 and len({(r.lang_pred, round(r.score, 6)) for r in got if r.doc_id != 9}) == 1
