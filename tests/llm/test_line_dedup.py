import random

import pytest
from pyspark.sql import functions as F

from helixmill.llm import line_dedup, queries


def test_repeated_rows_and_empty(spark):
    text = "\n".join(f"a line with the number {i}" for i in range(6))
    got = line_dedup.dedup(spark.createDataFrame([(1, text)] * 6 + [(2, text)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_deleted) for r in got) == [(1, 0)] * 6 + [(2, 6)]
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_runs(rows, min_chars):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ls = (t or "").split("\n")
        dead = set()
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                w = tuple(ls[i:j])
                if sum(map(len, w)) >= min_chars and w in seen:
                    dead |= set(range(i, j))
                seen.add(w)
        n_runs = sum(i - 1 not in dead for i in dead)
        out.append((d, len(ls), len(dead), n_runs, "\n".join(x for i, x in enumerate(ls) if i not in dead)))
    return sorted(out, key=str)


@pytest.mark.parametrize("chars", [1, 6, 9, 30])
def test_runs_of_any_number_of_lines(spark, chars):
    rnd = random.Random(chars)
    rows = [(None, "a\nb\nc\nd\ne"), (0, None), (1, ""), (2, "\n\n\n\n\n\n"), (3, "a\nb\nc\nd\ne\nf")]
    for i in range(4, 80):
        ls = [rnd.choice(["aa", "b", "é", "dd ", "", "line %d" % rnd.randint(0, 9), "long " * 7]) for _ in range(rnd.randint(1, 9))]
        if rnd.random() < 0.4:
            ls += (rnd.choice(rows)[1] or "").split("\n")
        rows.append((i, "\n".join(ls)))
    rnd.shuffle(rows)
    got = sorted((tuple(r) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit("x")), min_chars=chars).collect()), key=str)
    assert got == brute_runs(rows, chars)


def test_query_deletes_copies_of_one_and_two_lines(spark, tmp_path):
    one, two = "one line of many words " * 8, "first of two lines " * 3 + "\n" + "second of two lines " * 3
    spark.createDataFrame([(1, one), (2, two), (3, one), (4, two), (5, "short"), (6, "short"), (7, one + "\nown")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_deleted for r in queries.queries()["op1_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 2, 5: 0, 6: 0, 7: 1}


def test_intervals(spark):
    """A copied passage of many lines: the intervals cover it, with its copies and where it starts first."""
    lines = [f"line number {i:02d} with some words" for i in range(40)]
    rows = [(5, "\n".join(["head"] + lines)), (3, "\n".join(lines)), (9, "\n".join(lines[10:30] + ["tail"])), (7, "own words " * 20)]
    got = line_dedup.intervals(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=30 * 30).collect()
    assert {(r.depth, r.copies, r.first_doc) for r in got} == {(30, 2, 3)} and {r.first_line for r in got} == set(range(11))
    got = line_dedup.intervals(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=60).collect()
    assert {r.depth for r in got} == {2} and sum(r.copies == 3 for r in got) == 19


def test_hot_line_and_long_text(spark):
    """One line in most documents, and a text of many lines."""
    hot = "the same line of more than eighty characters that very many documents hold in common"
    rows = [(i, hot if i % 3 else f"{hot}\nown line {i}") for i in range(400)] + [(1000, "\n".join(["x"] * 20000))]
    got = {r.doc_id: (r.n_deleted, r.n_lines) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (0, 2) and all(got[i][0] == 1 for i in range(1, 400))
    assert got[1000] == (19999, 20000)
