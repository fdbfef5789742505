"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets
-------
Source k of the sources in code-point order (null last) weighs 5, 2, 1, 5, 2,
1, ...; targets share all words by weight, but none exceeds ``MAX_REPEAT``
times its source, the excess being shared again among the others.

Blocks
------
A source that is laid out in the order of a keyed permutation of its documents
is a tape of words; the mix takes the tape from its start, again and again,
until the target is met.  So every document is taken a whole number of times,
but the one at which the target ends, and none more than ``MAX_REPEAT`` times.
All laps of a tape are cut into blocks of ``BLOCK`` words (more, where there
would be over ``MOST_BLOCKS``, the limit of an exact draw); a document belongs to
the block in which it starts, so none is torn.

How many blocks of each source go to each shard is drawn by a binary tree over
the shards: a node splits its quotas by a multivariate hypergeometric draw, so
all quotas add up exactly and each shard looks like a draw without replacement
from the whole mix.  The blocks of a source are then drawn in the order of a
keyed permutation of their numbers, each shard its quota, so shards are
disjoint.  What a document is taken for is the sum of its laps whose block was
drawn.  Shards shuffle their documents locally by key.

Positions on a tape are prefix sums by source and hash range; ranges are as
many as the rows need, so that a hot source is summed in many parts and no task
holds it whole.  Per source and shard one number is broadcast; shards are at
most ``MOST_CUTS`` by the number of sources, which bounds that at 32 MB.

Edge cases: null or empty texts have size 0 and are never taken; sources
without words have target 0; an empty table gives an empty result; repeated rows
are documents of their own; ties of the permutation are broken by key and size,
and rows that are equal in both are interchangeable in size and number; extra
columns are kept by ``drawn_documents``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import Stash, blank_words

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK = 4096
MOST_BLOCKS = 500_000_000
#: Rows of a source that one task sums, at about.
RANGE_ROWS = 100_000
#: Shards at least, words of a shard at most where there are more, and bound of sources times shards.
SHARDS = 64
SHARD_WORDS = 1 << 28
MOST_CUTS = 4_000_000
SEED = 20240229


def _code_point(c: Column) -> Column:
    """Sorts strings by code point (UTF-8 keeps that order), null last."""
    return F.encode(c, "UTF-8").asc_nulls_last()


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEAT) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``; one row per source, in one window.

    Sources fill up in the order of ``size / weight``: a source is capped when
    its cap is below its share of what the earlier ones leave.
    """
    rank = Window.orderBy(_code_point(F.col("source")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    t = sizes.select("source", "source_size", w.alias("w")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), _code_point(F.col("source")))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    t = t.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / F.col("rest")).withColumn("capped", F.col("cap") / F.col("w") <= F.col("level"))
    # the level of the first source that is not capped holds for it and all after it
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), _source_key().alias("k"), "level"))).over(whole)
    return t.withColumn("at", level["level"]).select("source", "source_size", F.when(F.col("capped") | F.col("at").isNull(), F.col("cap")).otherwise(F.col("w") * F.col("at")).alias("target")).withColumn("target", F.round("target", 6))


def _source_key() -> Column:
    return F.coalesce(F.hex(F.encode("source", "UTF-8")), F.lit("~"))


def shard_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows), drawn down a binary tree; sums are exact."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        take = int(q.sum()) * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(q, take, method="marginals")
        split(left, lo, mid)
        split(q - left, mid, hi)

    split(np.array(quotas, np.int64), 0, shards)
    return out


def _order_of_blocks(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """Factor and shift of a permutation ``b -> (factor * b + shift) mod n`` of the blocks of a tape."""
    n = max(n, 1)
    while math.gcd(f := int(rng.integers(1, n + 1)), n) != 1:
        pass
    return f, int(rng.integers(0, n))


def _sized(docs: DataFrame, key: str, text: str, source: str, seed: int, bits: int, carry: list[Column]) -> DataFrame:
    """``__k`` places a document in the keyed permutation, ``__range`` is its leading part."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"))
    k = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    d = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{source}`").cast("string").alias("source"), F.size(blank_words(F.col(f"`{text}`"))).cast("long").alias("size"), k.alias("__k"), *carry)
    return d.withColumn("__s", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).withColumn("__range", F.shiftright("__k", 60 - bits))


def _drawn_by(block: Column) -> Column:
    """The shard that draws a block: the first whose run of the permuted numbers ends beyond the block's."""
    place = ((F.col("factor") * block + F.col("shift")) % F.col("blocks")).cast("long")

    def search(x: Column) -> Column:
        n = F.size("cuts")
        near = F.greatest(F.floor(x * n / F.col("blocks")).cast("int") - 32, F.lit(0))  # quotas are close to even, so it is mostly near here
        inside = lambda i: (F.get("cuts", i) > x) & (F.coalesce(F.get("cuts", i - 1), F.lit(0)) <= x)
        at = lambda lo, hi: F.get(F.filter(F.sequence(lo, hi), inside), F.lit(0))
        return F.coalesce(at(near, F.least(near + 64, n - 1)), at(F.lit(0), n - 1))

    return F.transform(F.array(place), search)[0]


_PIECES = "array<struct<shard:int,lap:int,words:bigint>>"


def layout(docs: DataFrame, key: str, text: str, source: str, shards: int | None, seed: int, carry: list[str] | None = None) -> DataFrame:
    """Per row: ``__id, size, source_size, target`` and ``pieces``, an array of ``(shard, lap, words)``; with ``carry``, also ``__doc``."""
    spark = docs.sparkSession
    stash = Stash(spark)
    more = [] if carry is None else [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("__doc")]
    bits = max(10, (docs.count() // RANGE_ROWS).bit_length())
    rows = _sized(docs, key, text, source, seed, bits, more)
    if carry is None:
        rows = stash.put(rows)  # numbers only; texts are rather read twice than written
    parts = rows.groupBy("source", "__s", "__range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("__s").orderBy("__range")
    parts = stash.put(parts.select("source", "__s", "__range", "words", (F.sum("words").over(before) - F.col("words")).alias("base")))
    goals = stash.put(targets(parts.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumn("goal", F.round("target").cast("long")))
    per_source = sorted(goals.limit(MOST_CUTS + 1).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    if len(per_source) > MOST_CUTS:
        raise ValueError(f"more than {MOST_CUTS} sources")
    total = sum(r["goal"] for r in per_source)
    block = max(BLOCK, -(-total // MOST_BLOCKS))
    shards = shards or max(1, min(max(SHARDS, -(-total // SHARD_WORDS)), MOST_CUTS // max(1, len(per_source))))
    quotas = [-(-r["goal"] // block) for r in per_source]
    dealt = np.cumsum(shard_quotas(quotas, shards, seed), axis=0) if quotas else np.zeros((shards, 0), np.int64)
    table = []
    for i, (r, n) in enumerate(zip(per_source, quotas, strict=True)):
        f, c = _order_of_blocks(n, np.random.default_rng([seed, i]))
        table.append(("n" if r["source"] is None else "s" + r["source"], r["source_size"], r["target"], r["goal"], n, f, c, dealt[:, i].tolist()))
    table = F.broadcast(spark.createDataFrame(table, "__s string, source_size long, target double, goal long, blocks long, factor long, shift long, cuts array<long>"))
    inner = Window.partitionBy("__s", "__range").orderBy("__k", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("__before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    on = run.join(parts.select("__s", "__range", "base"), ["__s", "__range"]).join(table, "__s")
    laps = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("int")
    on = on.withColumn("__start", F.col("base") + F.col("__before")).withColumn("__laps", laps)

    def lap(n: Column) -> Column:
        at = n * F.col("source_size") + F.col("__start")
        return F.struct(F.when(at < F.col("goal"), _drawn_by(F.floor(at / block))).alias("shard"), n.alias("lap"), F.least(F.col("size"), F.col("goal") - at).alias("words"))

    pieces = F.filter(F.transform(F.sequence(F.lit(0), F.col("__laps")), lap), lambda p: p["shard"].isNotNull())
    pieces = F.when(F.col("size") > 0, pieces).otherwise(F.array().cast(_PIECES))
    return on.select("__id", "size", "source_size", "target", "__k", pieces.alias("pieces"), *(["__doc"] if carry else []))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per document: key, ``size, source_size, target, taken`` and ``pieces`` (shard, lap, words from the start)."""
    d = layout(docs, key, text, source, shards, seed)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["words"])
    return d.select(F.col("__id").alias(key), "size", "source_size", "target", taken.alias("taken"), "pieces")


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of the white space after its ``n``-th word."""
    parts = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    blank = F.rlike(text, F.lit(r"^[\x20\x09-\x0D]")).cast("int")  # white space before the first word is a part of its own
    return F.transform(F.array(parts), lambda p: F.array_join(F.slice(p, F.lit(1), (n + blank).cast("int")), ""))[0]


def drawn_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixed corpus, to the word: documents with all their columns, once for each lap that takes them, by shard and locally shuffled.

    The document at which a source's target ends keeps only the words that are taken.
    """
    d = layout(docs, key, text, source, shards, seed, carry=docs.columns)
    d = d.select("__doc", "__k", "size", F.explode("pieces").alias("__p"))
    dealt = d.withColumn("__to", F.col("__p.shard")).repartition("__to").sortWithinPartitions("__to", F.xxhash64("__k", "__p.lap"))
    whole = F.col(f"__doc.`{text}`")
    cut = F.when(F.col("__p.words") < F.col("size"), first_words(whole, F.col("__p.words"))).otherwise(whole)
    return dealt.select(*[cut.alias(c) if c == text else F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])


ORACLE = f"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS n FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((n - 1) % 3 + 1)::INT] AS w, 3.0::DOUBLE * source_size AS cap FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, n) AS nth FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM o)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT min_by(level, nth) AS level FROM l WHERE cap / w > level),
t AS (SELECT source, source_size, round(CASE WHEN cap / w <= l.level OR f.level IS NULL THEN cap ELSE w * f.level END, 6) AS target FROM l, f),
p AS (SELECT d.*, source_size, target, round(target)::BIGINT AS goal, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS laps FROM p)
SELECT doc_id, size, source_size, target, (laps * size + greatest(0, least(size, goal - laps * source_size - start)))::BIGINT AS taken FROM q
"""
