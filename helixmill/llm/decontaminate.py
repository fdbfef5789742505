"""Benchmark decontamination by a prefix-filtered set join, with exact containment.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  The
windows of an item are its runs of ``WINDOW`` words; an item of fewer words,
but not none, is one window.  A document word inside any occurrence of a
window is hit.

Plan
----
1. Windows are taken as sequences of five-word shingles (of all their words
   where they have fewer than five).  Only document shingles that the
   benchmark holds leave the scan: a hash join with the benchmark's distinct
   shingles, broadcast behind a count, else shuffled.
2. The hits give each shingle's frequency.  Containment must be whole, so the
   necessary prefix of a window in order of rarity is its rarest shingle; a
   window with an absent shingle falls out.
3. Hits are joined with the prefixes.  Length and position bounds keep starts
   at which the window fits into the document.
4. The remaining starts go to their documents, and the words of the window are
   compared one by one.

Edge cases: null texts have no words; null keys are matched as equal; items
with equal windows all count; repeated document rows are judged and returned
each; with an empty benchmark nothing is hit; other columns are ignored by
``scan`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import Stash, ascii_lower, few_rows, maybe_broadcast

WINDOW = 10
SHINGLE = 5
#: Rows (of at most 24 bytes) up to which a side of a join is broadcast.
BROADCAST_ROWS = 500_000


def item_words(text: Column) -> Column:
    t = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(F.regexp_replace(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " ", -1), "")


def _shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; empty for fewer words."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.lit(size), *[F.get(words, i + j) for j in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def windows(items: DataFrame, item_key: str, item_text: str, window: int) -> DataFrame:
    """``item, words``: every window of every item, repeated ones included."""
    w = items.select(F.col(item_key).alias("item"), item_words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))), lambda i: F.slice(F.col("w"), i, window))
    return w.select("item", F.explode(cut).alias("words"))


def occurrences(docs: DataFrame, items: DataFrame, stash: Stash, key: str, text: str, item_key: str, item_text: str, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Starts that pass the bounds, per document (``doc, starts`` with window names), and ``wid, item``."""
    all_windows = stash.put(windows(items, item_key, item_text, window).select("item", "words", F.sha2(F.array_join("words", " "), 256).alias("wid")))
    distinct = stash.put(all_windows.groupBy("wid").agg(F.first("words").alias("words")))
    sizes = sorted(r[0] for r in distinct.select(F.least(F.size("words"), F.lit(shingle)).alias("s")).distinct().collect())  # at most ``shingle`` numbers
    parts = None
    for s in sizes:
        part = distinct.where(F.least(F.size("words"), F.lit(shingle)) == s).select("wid", F.size("words").alias("len"), F.posexplode(_shingles(F.col("words"), s)).alias("offset", "h"))
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return None, all_windows
    parts = stash.put(parts)
    wanted = maybe_broadcast(parts.select("h").distinct(), BROADCAST_ROWS)
    words = docs.select(F.col(key).alias("doc"), item_words(F.col(text)).alias("w"))
    hits = None
    for s in sizes:
        one = words.select("doc", F.size("w").alias("n"), F.posexplode(_shingles(F.col("w"), s)).alias("pos", "h")).join(wanted, "h")
        hits = one if hits is None else hits.unionByName(one)
    hits = stash.put(hits)
    freq = hits.groupBy("h").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("wid").orderBy("df", "h", "offset")
    ranked = parts.join(freq, "h", "left").select("wid", "len", "offset", "h", F.coalesce("df", F.lit(0)).alias("df")).withColumn("nth", F.row_number().over(rarest))
    prefix = stash.put(ranked.where("nth = 1 and df > 0").select("wid", "len", "offset", "h"))
    fits = (F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.col("len") <= F.col("n"))
    side = maybe_broadcast(prefix, BROADCAST_ROWS // 4)
    found = hits.join(side, "h").where(fits).select("doc", (F.col("pos") - F.col("offset")).alias("start"), "wid").distinct()
    named = found.join(maybe_broadcast(distinct, BROADCAST_ROWS // 10), "wid")
    return named.groupBy("doc").agg(F.collect_list(F.struct("start", "wid", "words")).alias("starts")), all_windows


def scan(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``key`` (or the ``carry`` columns), ``n_words, n_hit, n_items, items_sha256, contaminated``."""
    stash = Stash(docs.sparkSession)
    starts, all_windows = occurrences(docs, items, stash, key, text, item_key, item_text, window, shingle)
    out = [F.col(f"__doc.`{c}`").alias(c) for c in carry or [key]]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or [key]]).alias("__doc"), F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"))
    if starts is None:
        return src.select(*out, F.size(item_words(F.col("__text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))
    starts = stash.put(starts)
    hit = src.join(starts, src["__key"].eqNullSafe(starts["doc"]), "left").select("__doc", "__key", "starts", item_words(F.col("__text")).alias("w"))
    same = F.filter("starts", lambda x: F.slice(F.col("w"), x["start"] + 1, F.size(x["words"])) == x["words"])
    hit = hit.select("__doc", "__key", F.size("w").cast("long").alias("n_words"), F.when(F.col("starts").isNotNull(), same).alias("true"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("true", lambda x: F.sequence(x["start"], x["start"] + F.size(x["words"]) - 1)))))
    hit = hit.select("__doc", "n_words", F.when(F.size(F.coalesce("true", F.array())) > 0, covered).otherwise(0).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.transform("true", lambda x: x["wid"]))).alias("wids"))
    # items of the sets of windows that occur: each distinct set is looked up once
    hit = stash.put(hit)
    sets = hit.where("n_hit > 0").select("wids").distinct().select("wids", F.explode("wids").alias("wid"))
    owners = all_windows.select("wid", F.col("item").cast("string").alias("item")).distinct()
    items_of = sets.join(owners, "wid").groupBy("wids").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # documents without a hit don't take part in the join
    named = hit.where("n_hit > 0").join(items_of, "wids").select("__doc", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))
    done = named.unionByName(hit.where("n_hit = 0").select("__doc", "n_words", "n_hit", F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items")))
    return done.select(*out, "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The documents without any hit, with all their columns."""
    return scan(docs, items, carry=docs.columns, **kw).where("not contaminated").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, len(w[s:s + 9]) AS l, array_to_string(w[s:s + 9], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT doc_id, s, l, array_to_string(w[s:s + l - 1], ' ') AS win FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, lens WHERE len(w) >= l)),
h AS (SELECT DISTINCT doc_id, s, l, item_id FROM dw JOIN iw USING (l, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM (SELECT DISTINCT doc_id, s, l FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(t.ks, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
