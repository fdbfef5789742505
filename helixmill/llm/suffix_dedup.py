"""Byte-level removal of long repeats by ranking positions at growing lengths.

Every byte covered by a ``length``-byte string that also starts earlier
(smaller document, or same document and earlier start) is removed.  Strings
are judged on the input; overlaps count; matches never cross documents.

Plan
----
A suffix array of all positions would sort tens of bytes for every byte of
text.  Positions are therefore ranked sparsely first, and only those that are
still shared go on to the next length:

1. *Anchors.*  In each run of ``w`` consecutive k-grams (``k + w - 1 =
   length``) the one with the least hash is an anchor, so each string of
   ``length`` bytes holds one, at a place that its own bytes decide.  An
   anchor carries two ranks: of its k-gram, and of all bytes that the strings
   around it can reach.  Spark sorts these rank pairs.  Later members of a
   class with equal reach are repeats; first members whose k-gram is unique
   are dropped.
2. *Growing lengths.*  For the remaining anchors the offsets of the strings
   around them are halved again and again: the common part of the strings of a
   range of offsets grows towards ``length``.  At each step the positions are
   sorted by their rank pair (common part, whole reach), reranked, marked as
   repeats, dropped as unique or split, until common part and reach are one
   string of ``length`` bytes.
3. The marked ranges are united per document and cut out.

Ranks are pairs of 64-bit hashes of the bytes (one of the k-gram and one of the
reach for anchors, folded to one number inside a chunk; two of each string
after), so they need no global numbering and a lost task is recomputed alone.

Edge cases: a null text counts as empty; texts below ``length`` bytes lose
nothing; a null ``doc_id`` comes before all others; rows that share a doc_id
are ordered by their text, and identical rows count as one document (each of
them is returned); other columns are kept untouched by ``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.llm.common import Stash
from helixmill.llm.grams import Rolling, anchors, mix

LENGTH = 100
K = 50
#: Rows that a Python worker holds before it hands them on.
CHUNK = 100_000


def _u(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def repeats_keys(docs: DataFrame, key: str) -> bool:
    return bool(docs.groupBy(key).count().where("count > 1").limit(1).count())


def with_tie(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Adds ``tie``: 0, or the place of the text among the texts of a repeated key.

    Repeated keys are looked for first, on the key column alone.
    """
    if not repeats_keys(docs, key):
        return docs.withColumn("__tie", F.lit(0))
    w = Window.partitionBy(key).orderBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return docs.withColumn("__tie", F.dense_rank().over(w) - 1)


def increasing(keys: pa.Array) -> bool:
    """Whether integer keys rise strictly from row to row."""
    return pa.types.is_integer(keys.type) and not keys.null_count and bool((np.diff(keys.to_numpy()) > 0).all())


def _anchor_rows(length: int, k: int):
    w = length - k + 1
    width = w - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        for batch in batches:
            seeds, reach, row, pos = [], [], [], []

            def rows(batch=batch, seeds=seeds, reach=reach, row=row, pos=pos) -> pa.RecordBatch:
                r = np.repeat(row, [len(x) for x in pos])
                s, o, p = np.concatenate(seeds), np.concatenate(reach), np.concatenate(pos)
                if increasing(batch.column(0)):
                    # rows stand in the order of documents: what comes again in this chunk is known as a repeat, but for
                    # anchors of one document whose reach begins at the same byte, which are the same strings
                    first = np.zeros(len(p), bool)
                    kind, at = np.unique(mix(s) ^ o, return_index=True)
                    first[at] = True
                    lead = at[np.searchsorted(kind, mix(s) ^ o)]
                    first |= (r == r[lead]) & (np.maximum(p - width, 0) == np.maximum(p[lead] - width, 0))
                    sure = ~first
                    # neighbouring repeats of a document become one range: reach holds its last anchor, the place is
                    # written as -1 - place, and the seed is a number of its own
                    head = sure & np.r_[True, ~sure[:-1] | (r[1:] != r[:-1])]
                    last = sure & np.r_[~sure[1:] | (r[1:] != r[:-1]), True]
                    s[head] = mix(s[head] + p[head].astype(np.uint64) * np.uint64(2) + np.uint64(r[0] + 1))
                    o[head] = p[last].astype(np.uint64)
                    p = np.where(head, -1 - p, p)
                    keep = first | head
                    r, s, o, p = (x[keep] for x in (r, s, o, p))
                r = pa.array(r)
                out = pa.RecordBatch.from_arrays([_u(s), _u(o), batch.column(0).take(r), batch.column(1).take(r), pa.array(p.astype(np.int32))], names=["seed", "reach", "doc", "tie", "pos"])
                for x in (seeds, reach, row, pos):
                    x.clear()
                return out

            held = 0
            for i, text in enumerate(batch.column(2)):
                raw = text.as_buffer() if text.is_valid else b""
                n = len(raw) if text.is_valid else 0
                if n < length:
                    continue
                p = roll.prefix(np.frombuffer(raw, np.uint8))
                g = roll.grams(p, k)
                a = anchors(g, w)
                seeds.append(g[a])
                reach.append(roll.slices(p, np.maximum(a - (w - 1), 0), np.minimum(a + length, n)))
                row.append(i)
                pos.append(a)
                held += len(a)
                if held >= CHUNK:
                    held = 0
                    yield rows()
            if row:
                yield rows()

    return run


def _contexts(length: int, k: int):
    """Bytes that the strings around each shared anchor can reach."""
    w = length - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, start, ctx = [], [], [], []

            def rows(batch=batch, row=row, pos=pos, start=start, ctx=ctx) -> pa.RecordBatch:
                r = pa.array(row, pa.int64())
                out = pa.RecordBatch.from_arrays([batch.column(0).take(r), batch.column(1).take(r), pa.array(pos, pa.int32()), pa.array(start, pa.int32()), pa.array(ctx, pa.binary())], names=["doc", "tie", "pos", "start", "ctx"])
                for x in (row, pos, start, ctx):
                    x.clear()
                return out

            for i, (text, where) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                data = memoryview(text.as_buffer())
                for p in where.as_py():
                    row.append(i)
                    pos.append(p)
                    start.append(max(0, p - (w - 1)))
                    ctx.append(bytes(data[start[-1] : p + length]))
                if len(row) >= CHUNK // 8:
                    yield rows()
            yield rows()

    return run


def _split_rows(length: int):
    """For each range of offsets of an anchor: ranks of the common part and of the whole reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = Rolling(3), Rolling(7)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            pos, start, lo, hi = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3, 5, 6))
            ctx = batch.column(4)
            if isinstance(ctx, pa.ChunkedArray):
                ctx = ctx.combine_chunks()
            sizes = np.fromiter((len(x.as_buffer()) for x in ctx), np.int64, n)
            base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            data = np.frombuffer(b"".join(x.as_py() for x in ctx), np.uint8)
            end = start + sizes  # first byte out of reach
            s0, e0 = np.maximum(pos - hi, start), np.minimum(pos + length - lo, end)
            c0, c1 = pos - lo, pos + length - hi
            pa_, pb_ = a.prefix(data), b.prefix(data)
            off = base - start
            # the place of the anchor inside the common part takes part in its rank, as does the range
            tag = mix((lo * 1000 + hi).astype(np.uint64))
            cols = [_u(h.slices(p, x + off, y + off) + t) for x, y, t in ((c0, c1, tag), (s0, e0, np.zeros(n, np.uint64))) for h, p in ((a, pa_), (b, pb_))]
            ok = (e0 - s0 >= length) & (c1 <= end) & (c0 >= start)
            reach = pa.array([x.as_py()[y:z] for x, y, z in zip(ctx, s0 - start, np.maximum(e0 - start, 0), strict=True)], pa.binary())
            left = [*batch.columns[:3], pa.array(s0.astype(np.int32)), reach, *batch.columns[5:]]
            out = pa.RecordBatch.from_arrays([*left, *cols, pa.array(s0.astype(np.int32)), pa.array(e0.astype(np.int32))], names=[*batch.schema.names, "c1", "c2", "o1", "o2", "s0", "e0"])
            yield out.filter(pa.array(ok))

    return run


def repeated_ranges(docs: DataFrame, stash: Stash, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K) -> DataFrame:
    """Ranges of bytes that repeats cover: ``doc, tie, spans`` with ``spans`` an array of ``(s, e)``, not yet united.

    ``docs`` needs the column ``__tie`` of :func:`with_tie`.
    """
    if not 2 <= k <= length:
        raise ValueError("k must lie between 2 and length")
    width = length - k
    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("doc"), F.col("__tie").alias("tie"), F.col(text).alias("text"))
    rows = src.mapInArrow(_anchor_rows(length, k), f"seed long, reach long, doc {kind}, tie int, pos int")
    # anchors are ordered by where their reach begins; those of one document that begin alike are one
    same = Window.partitionBy("seed", "reach").orderBy("doc", "tie", F.greatest(F.col("pos") - width, F.lit(0)))
    seed = Window.partitionBy("seed")
    first = stash.put(
        rows.repartition("seed")
        .select("*", F.rank().over(same).alias("nth"), (F.min("reach").over(seed) != F.max("reach").over(seed)).alias("open"))
        .where("pos < 0 or nth > 1 or open")
        .select("doc", "tie", F.when(F.col("pos") < 0, -1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"), F.when(F.col("pos") < 0, F.col("reach").cast("int")).otherwise(F.col("pos")).alias("to"), ((F.col("pos") < 0) | (F.col("nth") > 1)).alias("again")),
    )
    marks = [first.where("again").select("doc", "tie", F.greatest(F.lit(0), F.col("pos") - width).alias("s"), (F.col("to") + length).alias("e"))]
    live = first.where("not again").groupBy("doc", "tie").agg(F.collect_set("pos").alias("where"))
    current = (
        src.join(live, src["doc"].eqNullSafe(live["doc"]) & (src["tie"] == live["tie"]))
        .select(src["doc"], src["tie"], "text", "where")
        .mapInArrow(_contexts(length, k), f"doc {kind}, tie int, pos int, start int, ctx binary")
        .select("*", F.lit(0).alias("lo"), F.lit(width).alias("hi"))
    )
    open_ranges, same, common = width + 1, Window.partitionBy("c1", "c2", "o1", "o2").orderBy("doc", "tie", "s0"), Window.partitionBy("c1", "c2")
    while open_ranges > 1:
        middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = current.withColumn("range", F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi"))))).select("doc", "tie", "pos", "start", "ctx", "range.lo", "range.hi").where("lo <= hi")
        step = stash.put(
            halves.mapInArrow(_split_rows(length), f"doc {kind}, tie int, pos int, start int, ctx binary, lo int, hi int, c1 long, c2 long, o1 long, o2 long, s0 int, e0 int")
            .repartition("c1")
            .select("*", F.rank().over(same).alias("nth"), ((F.min("o1").over(common) != F.max("o1").over(common)) | (F.min("o2").over(common) != F.max("o2").over(common))).alias("open"))
            .where("nth > 1 or open")
            .select("doc", "tie", "pos", "start", F.when(F.col("nth") == 1, F.col("ctx")).alias("ctx"), "lo", "hi", "s0", "e0"),
        )
        marks.append(step.where("ctx is null").select("doc", "tie", F.col("s0").alias("s"), F.col("e0").alias("e")))
        current = step.where("ctx is not null").select("doc", "tie", "pos", "start", "ctx", "lo", "hi")
        open_ranges = (open_ranges + 1) // 2
    found = marks[0]
    for more in marks[1:]:
        found = found.unionByName(more)
    return found.groupBy("doc", "tie").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def _cut(with_text: bool):
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            out: list[list] = [[] for _ in names]
            for text, spans in zip(batch.column(n - 2), batch.column(n - 1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                removed = runs = at = 0
                kept = []
                for s, e in sorted((x["s"], min(x["e"], len(raw))) for x in spans.as_py() or ()):
                    if s > at or not runs:
                        kept.append(raw[at:s])
                        runs += 1
                        at = s
                    if e > at:
                        removed += e - at
                        at = e
                kept.append(raw[at:])
                left = b"".join(kept)
                for column, value in zip(out, (len(raw), removed, runs, hashlib.sha256(left).hexdigest(), left), strict=False):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], *(pa.array(x, t) for x, t in zip(out, types, strict=False))], names=[*batch.schema.names[: n - 2], *names])

    return run


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K, with_text: bool = True) -> DataFrame:
    """One row per document: its key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, if asked for, the bytes kept."""
    stash = Stash(docs.sparkSession)
    tied = with_tie(docs.select(key, text), key, text)
    spans = stash.put(repeated_ranges(tied, stash, key, text, length, k))
    stash.drop_others(spans)
    kind = docs.schema[key].dataType.simpleString()
    joined = tied.join(spans, tied[key].eqNullSafe(spans["doc"]) & (tied["__tie"] == spans["tie"]), "left").select(tied[key], tied[text], "spans")
    return joined.mapInArrow(_cut(with_text), f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(h[2 * i + 1:2 * i + {2 * LENGTH}]) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS i FROM d WHERE len(h) >= {2 * LENGTH})),
a AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM w) WHERE rn > 1),
m AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 1 ELSE 0 END AS new FROM a),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m),
r AS (SELECT doc_id, min(i) AS s, max(i) + {LENGTH} AS e FROM n GROUP BY doc_id, run),
p AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM r),
x AS (SELECT p.doc_id, count(*) AS runs, sum(e - s) AS gone, string_agg(h[2 * b + 1:2 * s], '' ORDER BY s) || any_value(h)[2 * max(e) + 1:] AS kept FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN x USING (doc_id)
"""
