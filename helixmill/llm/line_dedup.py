"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

The lines of a document (split at ``\\n``) are a sequence of line IDs; suffixes
start at every line.  Ranks of suffixes by their first h lines are doubled:
Spark pairs the rank of a suffix with that of the one h lines on, equal pairs
get one rank, and suffixes with a rank of their own drop out.  This goes on
until all are unique or h is past the longest window that is asked for.

A window is a shortest run of lines with ``min_chars`` characters, from each
line on and up to each line.  Its rank is that of the pair of power-of-two
prefixes that cover it (at its start, and up to its end).  Windows of one rank
and length are the longest-common-prefix interval of that depth: in each, the
one that starts first (smaller document, or same document and earlier line)
stays, and the lines of all others are deleted.  Overlapping and touching
windows join to the maximal repeated runs of one line or more: a line goes if
and only if some run of lines around it with ``min_chars`` characters or more
also starts earlier.  :func:`intervals` returns the intervals themselves.

Ranks that many suffixes share (one line in a third of all documents) are split
off: those with over a ``HOT``-th of all rows are fewer than ``HOT``, are
broadcast for that, and their rows never meet in one task.

Edge cases: null text counts as empty (one empty line); a line counts with its
exact characters, blank ones too; documents of fewer than ``min_chars``
characters lose nothing; a null key comes first; rows that share a key are
ordered by text, identical ones count as one document and are returned each;
very long texts are handled whole; other columns are ignored.  Line IDs and
ranks are pairs of 64-bit hashes, checked by nothing else: at 2^40 different
lines a false match has a chance of about 2^-48.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import Stash
from helixmill.llm.suffix_dedup import repeats_keys, with_tie

MIN_CHARS = 80
HOT = 1000
RANK = ["r1", "r2"]


def _classes(rows: DataFrame, stash: Stash, *aggs) -> tuple[DataFrame, DataFrame]:
    """Ranks that two rows or more share, with ``n`` and ``aggs``: the common and the hot ones."""
    shared = stash.put(rows.groupBy(*RANK).agg(F.count("*").alias("n"), *aggs).where("n > 1"))
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    return shared.where(F.col("n") <= total / HOT), shared.where(F.col("n") > total / HOT)


def _with_class(rows: DataFrame, classes: tuple[DataFrame, DataFrame], *cols: str) -> DataFrame:
    """Rows of shared ranks with columns of their class; rows of hot ranks aren't shuffled."""
    common, hot = (c.select(*RANK, *cols) for c in classes)
    hot = F.broadcast(hot)  # fewer than HOT rows
    return rows.join(hot.select(*RANK), RANK, "left_anti").join(common, RANK).unionByName(rows.join(hot, RANK))


def _windows(min_chars: int):
    """Shortest windows of lines with ``min_chars`` characters from each line on and up to each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, spans = [], []
            for i, text in enumerate(batch.column(2)):
                lines = (text.as_py() or "").split("\n")
                n = len(lines)
                chars = np.cumsum([0, *map(len, lines)])
                if chars[-1] < min_chars:
                    continue
                on = np.maximum(np.searchsorted(chars, chars[:-1] + min_chars), np.arange(n) + 1)  # one past the last line
                to = np.minimum(np.searchsorted(chars, chars[1:] - min_chars, "right") - 1, np.arange(n))
                w = np.unique(np.concatenate([np.stack([np.arange(n), on], 1)[on <= n], np.stack([to, np.arange(n) + 1], 1)[to >= 0]]), axis=0)
                row.append(np.full(len(w), i))
                spans.append(w)
            if row:
                r, w = pa.array(np.concatenate(row)), np.concatenate(spans).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(r), batch.column(1).take(r), pa.array(np.ascontiguousarray(w[:, 0])), pa.array(np.ascontiguousarray(w[:, 1]))], names=["doc", "tie", "s", "e"])

    return run


def _at(ranks: DataFrame, name: str, shift: int = 0) -> DataFrame:
    """Ranks by ``doc, tie`` and place under names of their own."""
    return ranks.select(F.col("doc").alias(f"{name}d"), F.col("tie").alias(f"{name}t"), (F.col("pos") + shift).alias(f"{name}p"), F.col("r1").alias(f"{name}1"), F.col("r2").alias(f"{name}2"))


def _meets(rows: DataFrame, place: str, other: DataFrame, name: str) -> DataFrame:
    return rows.join(other, rows["doc"].eqNullSafe(other[f"{name}d"]) & (rows["tie"] == other[f"{name}t"]) & (rows[place] == other[f"{name}p"]))


def ranked_windows(tied: DataFrame, stash: Stash, key: str, text: str, min_chars: int) -> DataFrame:
    """``doc, tie, s, e, r1, r2``: windows that may recur, with their rank among those of the same length."""
    kind = tied.schema[key].dataType.simpleString()
    src = tied.select(F.col(f"`{key}`").alias("doc"), F.col("__tie").alias("tie"), F.col(f"`{text}`").alias("text"))
    if repeats_keys(tied, key):
        src = src.dropDuplicates(["doc", "tie"])  # rows alike in both have the same text
    windows = stash.put(src.mapInArrow(_windows(min_chars), f"doc {kind}, tie int, s int, e int"))
    lines = src.select("doc", "tie", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    ranks = stash.put(lines.select("doc", "tie", "pos", F.xxhash64("line").alias("r1"), F.xxhash64(F.lit(1), "line").alias("r2")))
    longest = windows.agg(F.coalesce(F.max(F.col("e") - F.col("s")), F.lit(0)).alias("n")).first()["n"]
    found, h = None, 1
    while h <= longest:
        live = stash.put(_with_class(ranks, _classes(ranks, stash), "n").drop("n"))
        stash.drop(ranks)
        size = F.col("e") - F.col("s")
        here = windows.where((size >= h) & (size < 2 * h))
        both = _meets(_meets(here, "s", _at(live, "x"), "x"), "e", _at(live, "y", h), "y")
        part = stash.put(both.select("doc", "tie", "s", "e", F.xxhash64("x1", "y1", size).alias("r1"), F.xxhash64(size, "y2", "x2").alias("r2")))
        found = part if found is None else found.unionByName(part)
        pairs = _meets(live, "pos", _at(live, "z", -h), "z")
        ranks = stash.put(pairs.select("doc", "tie", "pos", F.xxhash64("r1", "z1").alias("r1"), F.xxhash64("z2", "r2").alias("r2")))
        stash.drop(live)
        if not ranks.limit(1).count():
            break
        h *= 2
    return found if found is not None else windows.select("*", F.lit(0).cast("long").alias("r1"), F.lit(0).cast("long").alias("r2")).limit(0)


def intervals(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Longest-common-prefix intervals: ``depth`` in lines, ``copies``, and ``first_doc, first_line`` where they start first."""
    stash = Stash(docs.sparkSession)
    w = ranked_windows(with_tie(docs.select(key, text), key, text), stash, key, text, min_chars)
    place = F.min(F.struct("doc", "tie", "s")).alias("first")
    out = w.groupBy(*RANK).agg(F.count("*").alias("copies"), (F.max(F.col("e") - F.col("s"))).alias("depth"), place).where("copies > 1")
    return out.select("depth", "copies", F.col("first.doc").alias("first_doc"), F.col("first.s").alias("first_line"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: key, ``n_lines, n_deleted, n_runs`` and the ``kept`` text."""
    stash = Stash(docs.sparkSession)
    tied = with_tie(docs.select(key, text), key, text)
    windows = ranked_windows(tied, stash, key, text, min_chars)
    place = F.struct("doc", "tie", "s")
    again = _with_class(windows, _classes(windows, stash, F.min(place).alias("first")), "first").where(place != F.col("first"))
    spans = again.groupBy("doc", "tie").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    gone = stash.put(spans.select("doc", "tie", F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["e"] - 1))))).alias("gone")))
    stash.drop_others(gone)
    none = F.array().cast("array<int>")
    j = tied.join(gone, tied[key].eqNullSafe(gone["doc"]) & (tied["__tie"] == gone["tie"]), "left").select(tied[key], F.split(F.coalesce(tied[text], F.lit("")), "\n", -1).alias("ls"), F.coalesce("gone", none).alias("gone"))
    runs = F.filter("gone", lambda x, i: (i == 0) | (F.get("gone", i - 1) != x - 1))
    keep = F.array_except(F.sequence(F.lit(0), F.size("ls") - 1), "gone")
    kept = F.when(F.size("gone") == 0, F.array_join("ls", "\n")).otherwise(F.array_join(F.transform(keep, lambda i: F.get("ls", i)), "\n"))
    return j.select(key, F.size("ls").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_deleted"), F.size(runs).cast("long").alias("n_runs"), kept.alias("kept"))


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
c AS (SELECT doc_id, i, coalesce(sum(len(line)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, sum(len(line)) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM p),
w AS (SELECT x.doc_id, x.i AS s, min(y.i) AS e FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.b - x.a >= {MIN_CHARS} GROUP BY ALL
    UNION SELECT y.doc_id, max(x.i), y.i FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.b - x.a >= {MIN_CHARS} GROUP BY y.doc_id, y.i),
k AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY ls[s:e] ORDER BY doc_id, s) AS rn FROM w JOIN d USING (doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM k WHERE rn > 1),
n AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
t AS (SELECT doc_id, count(*) AS gone, count(DISTINCT run) AS runs, list(i) AS dead FROM n GROUP BY doc_id)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_deleted, coalesce(runs, 0)::BIGINT AS n_runs,
    sha256(CASE WHEN dead IS NULL THEN array_to_string(ls, chr(10)) ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(dead, i)), lambda i: ls[i]), chr(10)), '') END) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
