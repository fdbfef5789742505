"""Jaccard self-join on word shingles by grouped prefixes, and its connected classes.

A document's set holds its distinct shingles of ``N`` words (A-Z lower-cased,
words split at white space); a text with fewer words is one shingle; a text
without words has the empty set and links with nothing.  Two documents link
when ``100 * |x & y| >= PERCENT * |x | y|``.

Plan
----
1. *Rarity.*  All shingles are counted (a pre-summed, 4-byte-a-shingle shuffle);
   those in more than ``T`` documents are heavy.  ``T`` doubles until at most
   ``MAX_HEAVY`` are, which bounds what is broadcast.
2. *Prefixes.*  In the order light before heavy, then hash, two sets that link
   share one of their first ``|x| - ceil(0.75 |x|) + 1`` shingles.  Documents
   with equal sets form a class, classes with equal prefix and size a group; a
   group sends its prefix once per task.  Shingles of one group only fall out.
3. *Stars.*  In each list of groups that share a prefix shingle all are paired
   with the one that has the fewest light shingles, under bounds of length,
   position and, where the shared one is heavy, of the number of heavy ones, expanded to classes,
   sifted by parity bitmaps and verified on the whole sets.  Links contract to components.
4. *Rest.*  Lists that still span several components give the pairs across
   components, again under both bounds, expanded and verified.  Pairs inside a
   component are never made: they can't change the classes.

So no link between different texts is lost, while a group of m copies costs m
pairs, not m * m.

Edge cases: null text counts as empty; an empty or null text has 0 shingles and
its own doc_id as component; a null doc_id is never the name of a component
with other members; repeated rows are returned each; other columns are ignored.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import Stash
from helixmill.llm.graph import components
from helixmill.llm.grams import Rolling, mix

N = 5
PERCENT = 75
T = 32
MAX_HEAVY = 1_000_000
CHUNK = 200_000
#: Bytes of text for each bucket in which shingles are counted; a bucket is held by one task.
BUCKET_BYTES = 1 << 24
BITS = 1024
MAX_BITS = 1 << 18
#: Members of a star that one task verifies against its centre.
STAR = 256
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(raw, roll: Rolling) -> np.ndarray:
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(_BLANK[data].astype(np.int8), prepend=1, append=1))
    return roll.slices(roll.prefix(data), edge[::2], edge[1::2])


def shingle_set(text, roll: Rolling, n: int = N) -> np.ndarray:
    """Sorted distinct shingle hashes of an Arrow string scalar."""
    raw = text.as_buffer() if text.is_valid else None
    if raw is None or not len(raw):
        return np.zeros(0, np.uint64)
    w = word_hashes(raw, roll)
    if not len(w):
        return w
    m = min(n, len(w))
    h = np.full(len(w) - m + 1, m, np.uint64)
    for i in range(m):
        h = mix(h * _ODD[i % len(_ODD)] + w[i : len(w) - m + 1 + i])
    return np.unique(h)


def set_name(s: np.ndarray) -> int:
    return int(mix(np.add.reduce(mix(s ^ _ODD[1]), keepdims=True) + np.uint64(len(s)))[0].view(np.int64))


def parity(s: np.ndarray) -> bytes:
    """Bit i: whether an odd number of members end in i.  Sets differ in at least as many members as these bits do.

    A set has two bits or more for each member, up to ``MAX_BITS``.
    """
    bits = min(MAX_BITS, max(BITS, 1 << (2 * len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two parities differ; the longer is folded to the length of the shorter."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    n = min(len(x), len(y))
    x, y = np.bitwise_xor.reduce(x.reshape(-1, n)), np.bitwise_xor.reduce(y.reshape(-1, n))
    return int(np.bitwise_count(x ^ y).sum())


def _count_rows(n: int, bits: int):
    """Per task: shingles by bucket, each once with its count, as packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, held, size = Rolling(), [], 0

        def flush() -> pa.RecordBatch:
            v, c = np.unique(np.concatenate(held) >> np.uint64(32 - bits), return_counts=True)
            held.clear()
            bucket = (v >> np.uint64(32)).astype(np.int32)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            v, c = v.astype(np.uint32), np.minimum(c, 2**32 - 1).astype(np.uint32)
            pieces = [(v[s:e].tobytes(), c[s:e].tobytes()) for s, e in zip(cut, np.append(cut[1:], len(v)))]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array([x for x, _ in pieces], pa.binary()), pa.array([y for _, y in pieces], pa.binary())], names=["bucket", "values", "counts"])

        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text, roll, n)
                held.append(s)
                size += len(s)
                if size >= 3_000_000:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return run


def _heavy_rows(least: int):
    """Shingles counted more than ``least`` times; a bucket's pieces arrive one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vs, cs = None, [], []

        def done():
            v, c = np.concatenate(vs), np.concatenate(cs).astype(np.int64)
            u, i = np.unique(v, return_inverse=True)
            total = np.bincount(i, weights=c).astype(np.int64)
            big = total > least
            return pa.RecordBatch.from_arrays([pa.array((at << 32) + u[big].astype(np.int64)), pa.array(total[big])], names=["shingle", "df"])

        for batch in batches:
            for b, v, c in zip(*(batch.column(i) for i in range(3)), strict=True):
                b = b.as_py()
                if b != at and vs:
                    yield done()
                    vs, cs = [], []
                at = b
                vs.append(np.frombuffer(v.as_py(), np.uint32))
                cs.append(np.frombuffer(c.as_py(), np.uint32))
        if vs:
            yield done()

    return run


def bucket_bits(texts: DataFrame) -> int:
    """Log of the number of buckets, by the bytes of text: 12 at least and 31 at most."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    return min(31, max(12, (size // BUCKET_BYTES).bit_length()))


def heavy_shingles(texts: DataFrame, stash: Stash, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted heavy shingles (their first 32 bits after the bucket's), the log2 of their counts, and the bucket's bits; at most ``MAX_HEAVY``."""
    bits = bucket_bits(texts)
    rows = texts.mapInArrow(_count_rows(n, bits), "bucket int, values binary, counts binary")
    found = stash.put(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_heavy_rows(T), "shingle long, df long"))
    by_size = {r[0]: r[1] for r in found.groupBy(F.floor(F.log2("df")).cast("int").alias("k")).count().collect()}  # at most 63 rows
    t, total = 0, sum(by_size.values())
    while total > MAX_HEAVY:
        total -= by_size.pop(t, 0)
        t += 1
    got = found.where(F.floor(F.log2("df")) >= t).toArrow()
    stash.drop(found)
    h, df = got.column("shingle").to_numpy().astype(np.uint64), got.column("df").to_numpy()
    o = np.argsort(h)
    return h[o], np.log2(df[o]).astype(np.uint8), bits


def ordered(s: np.ndarray, heavy: np.ndarray, weight: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """A set in the order that prefixes use: light first, heavy ones by count, then by hash; and how many are light."""
    if not len(heavy) or not len(s):
        return s, len(s)
    short = s >> np.uint64(32 - bits)
    i = np.minimum(np.searchsorted(heavy, short), len(heavy) - 1)
    w = np.where(heavy[i] == short, weight[i], 0)
    return (s[np.lexsort((s, w))], int((w == 0).sum())) if w.any() else (s, len(s))


def _prefix_rows(shared, n: int, percent: int):
    """Rows of documents (``pos``: light shingles in the prefix) and of prefix shingles (``pos``: place, or -1 - place of a heavy one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, weight, bits_of = shared.value
        roll, seen = Rolling(), set()
        for batch in batches:
            doc, size, cid, gid, bits, light = [], [], [], [], [], []
            tok, tg, ts, tp = [], [], [], []

            def rows(batch=batch, doc=doc, size=size, cid=cid, gid=gid, bits=bits, light=light, tok=tok, tg=tg, ts=ts, tp=tp) -> pa.RecordBatch:
                d, k = len(doc), sum(map(len, tok))
                none = lambda m, t: pa.nulls(m, t)
                join = lambda x, y: pa.concat_arrays([x, y])
                token = np.concatenate(tok) if tok else np.zeros(0, np.uint64)
                lens = [len(x) for x in tok]
                out = pa.RecordBatch.from_arrays([
                    join(none(d, pa.int64()), pa.array(token.view(np.int64))),
                    join(pa.array(gid, pa.int64()), pa.array(np.repeat(np.array(tg, np.int64), lens))),
                    join(pa.array(size, pa.int32()), pa.array(np.repeat(np.array(ts, np.int32), lens))),
                    join(pa.array(light, pa.int32()), pa.array(np.concatenate(tp).astype(np.int32) if tp else np.zeros(0, np.int32))),
                    join(batch.column(0).take(pa.array(doc, pa.int64())), none(k, batch.column(0).type)),
                    join(pa.array(cid, pa.int64()), none(k, pa.int64())),
                    join(pa.array(bits, pa.binary()), none(k, pa.binary())),
                ], names=["token", "gid", "size", "pos", "doc", "cid", "bits"])
                for x in (doc, size, cid, gid, bits, light, tok, tg, ts, tp):
                    x.clear()
                return out

            held = 0
            for i, text in enumerate(batch.column(1)):
                s = shingle_set(text, roll, n)
                doc.append(i)
                size.append(len(s))
                if not len(s):
                    cid.append(None)
                    gid.append(None)
                    bits.append(None)
                    light.append(0)
                    continue
                p, n_light = ordered(s, heavy, weight, bits_of)
                p = p[: len(s) - -(-len(s) * percent // 100) + 1]
                n_light = min(n_light, len(p))
                light.append(n_light)
                cid.append(set_name(s))
                bits.append(parity(s))
                gid.append((set_name(p) ^ (len(s) << 1)) & (2**63 - 1))
                if gid[-1] not in seen:
                    seen.add(gid[-1])
                    tok.append(p)
                    tg.append(gid[-1])
                    ts.append(len(s))
                    place = np.arange(len(p))
                    place[n_light:] = -1 - place[n_light:]
                    tp.append(place)
                    held += len(p)
                if held >= CHUNK:
                    held = 0
                    yield rows()
            yield rows()

    return run


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and of tokens that at least two groups hold; tokens arrive sorted."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        token = table.column("token").combine_chunks()
        last = token[len(token) - 1].as_py() if len(token) else None
        if last is None:  # rows of documents come first
            yield from table.to_batches()
            rest = None
            continue
        t = token.fill_null(0).to_numpy(zero_copy_only=False)
        doc = token.is_null().to_numpy(zero_copy_only=False)
        g = table.column("gid").combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
        tail = ~doc & (t == last)
        # the last token may go on in the next batch; once it is known to be shared its rows can go
        start = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (doc[1:] != doc[:-1])]) if len(t) else np.zeros(0, int)
        mixed = np.minimum.reduceat(g, start) != np.maximum.reduceat(g, start)
        keep = np.repeat(mixed, np.diff(np.r_[start, len(t)])) | doc
        last_rows = table.filter(pa.array(tail))
        if mixed[-1]:
            yield from table.filter(pa.array(keep)).to_batches()
            gs = last_rows.column("gid").to_numpy()
            # one row of each of two groups stays, so that later rows of the token pass too; callers drop repeated rows
            rest = pa.concat_tables([last_rows.slice(0, 1), last_rows.slice(int(np.flatnonzero(gs != gs[0])[0]), 1)])
        else:
            yield from table.filter(pa.array(keep & ~tail)).to_batches()
            rest = last_rows.slice(0, 1)  # all are of one group, hence equal
    if rest is not None and rest.num_rows:
        gs = rest.column("gid").to_numpy(zero_copy_only=False)
        if len(gs) and gs.min() != gs.max():
            yield from rest.to_batches()


def _possible(percent: int):
    """Pairs that the bitmaps of two sets do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sx, sy = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            least = np.fromiter((apart(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(4), batch.column(5), strict=True)), np.int64, batch.num_rows)
            common = (sx + sy - least) // 2
            keep = 100 * common >= percent * (sx + sy - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _set_rows(n: int):
    """The set of a text once for each star that it takes part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling()
        names = ["a", "salt", "other", "cid", "shingles"]
        types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            for text, want, stars in zip(*(batch.column(i) for i in range(3)), strict=True):
                s = shingle_set(text, roll, n)
                if len(s) and set_name(s) == want.as_py():  # another row with the same key can hold another text
                    raw = s.tobytes()
                    for star in stars.as_py():
                        for column, value in zip(out, (star["a"], star["salt"], star["other"], want.as_py(), raw), strict=True):
                            column.append(value)
                        held += len(s)
                if held >= CHUNK:
                    held = 0
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=names)

    return run


def _verify(percent: int):
    """Stars arrive centre first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, None
        for batch in batches:
            a, b = [], []
            for c, salt, other, cid, shingles in zip(*(x.to_pylist() if i < 4 else x for i, x in enumerate(batch.columns)), strict=True):
                if not other:
                    at, centre = (c, salt), np.frombuffer(shingles.as_py(), np.uint64)
                    continue
                assert at == (c, salt), "a star without its centre"
                z = np.sort(np.concatenate([centre, np.frombuffer(shingles.as_buffer(), np.uint64)]), kind="stable")
                common = int((z[1:] == z[:-1]).sum())
                if 100 * common >= percent * (len(z) - common):
                    a.append(c)
                    b.append(cid)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _bounds(x, y, percent: int) -> Column:
    """Length and positional bounds, and that of shingles which can be common at all, of a pair that shares a token."""
    need = F.ceil(percent * (x("size") + y("size")) / (100.0 + percent) - 1e-9)
    return (
        (100 * F.least(x("size"), y("size")) >= percent * F.greatest(x("size"), y("size")))
        & (F.least(x("size") - x("pos"), y("size") - y("pos")) + F.least(x("pos"), y("pos")) >= need)
        & (F.least(x("most"), y("most")) >= need)
    )


def linked_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per document: its key, ``n_shingles`` and ``component_id``."""
    spark = docs.sparkSession
    stash = Stash(spark)
    t = F.col(f"`{text}`")
    # a document is (no key, key, hash of the text): keyed ones come first, and rows without a key or with the same one stay apart
    kind = f"struct<z:boolean,id:{docs.schema[key].dataType.simpleString()},th:bigint>"
    src = docs.select(F.struct(F.col(f"`{key}`").isNull().alias("z"), F.col(f"`{key}`").alias("id"), F.xxhash64(t).alias("th")).alias("doc"), t.alias("text"))
    shared = spark.sparkContext.broadcast(heavy_shingles(src.select("text"), stash, n))
    schema = f"token long, gid long, size int, pos int, doc {kind}, cid long, bits binary"
    rows = src.mapInArrow(_prefix_rows(shared, n, percent), schema)
    spread = F.when(F.col("token").isNull(), F.xxhash64("doc", "cid")).otherwise(F.xxhash64("token"))  # a hash of null is a number too
    mixed = stash.put(rows.withColumn("spread", spread).repartition("spread").drop("spread").sortWithinPartitions(F.col("token").asc_nulls_first()).mapInArrow(_shared_only, schema))
    members = stash.put(mixed.where("token is null").select("doc", "size", "cid", "gid"))
    classes = stash.put(mixed.where("token is null and cid is not null").groupBy("cid").agg(F.min("gid").alias("gid"), F.min("size").alias("size"), F.min("doc").alias("doc"), F.min("pos").alias("light"), F.min("bits").alias("bits")))
    # where two prefixes share a heavy shingle they hold all light ones of their sets: if a light one is common too, the
    # pair stands in its (short) list, else only heavy ones can be common
    tokens = mixed.where("token is not null").select("token", "gid", "size", "pos").distinct()
    light = classes.groupBy("gid").agg(F.min("light").alias("light"))
    heavy = F.col("pos") < 0
    lists = tokens.join(light, "gid").select("token", "gid", "size", F.when(heavy, -1 - F.col("pos")).otherwise(F.col("pos")).alias("pos"), F.when(heavy, F.col("size") - F.col("light")).otherwise(F.col("size")).alias("most"))
    lists = stash.put(lists.where(100 * F.col("most") >= percent * F.col("size")))
    stash.drop(mixed)

    # stars: the least group of each list with the others, and the least class of each group with the others
    # the centre is the group with the fewest light shingles, which an original is among its edited copies;
    # that is the same group for all shingles of a copied text, so that its star is made once
    least = lists.withColumn("own", F.col("size") - F.col("most")).groupBy("token").agg(F.min(F.struct("own", "gid", "pos", "size", "most")).alias("c"))
    star = lists.join(least, "token").where((F.col("gid") != F.col("c.gid")) & _bounds(lambda k: F.col(k), lambda k: F.col(f"c.{k}"), percent)).select(F.col("c.gid").alias("ga"), F.col("gid").alias("gb")).distinct()
    first = classes.groupBy("gid").agg(F.min("cid").alias("first"))
    across = star.join(first, star["ga"] == first["gid"]).select(F.col("first").alias("a"), "gb").join(classes, F.col("gb") == classes["gid"]).select("a", F.col("cid").alias("b"))
    inside = classes.join(first, "gid").where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b"))
    pairs = stash.put(_sifted(across.unionByName(inside).distinct(), classes, percent))
    links = stash.put(_checked(pairs, classes, src, stash, n, percent))
    roots = components(links, stash) if links.limit(1).count() else None

    # the rest: pairs across components in lists that span several
    if roots is not None:
        placed = stash.put(classes.join(roots, classes["cid"] == roots["node"], "left").select("cid", "gid", F.coalesce("root", "cid").alias("root")))
    else:
        placed = classes.select("cid", "gid", F.col("cid").alias("root"))
    # members of a list as (group, component): a group's classes of one component are one entry here
    entry = placed.groupBy("gid", "root").agg(F.count("*").alias("n"))
    spans = lists.join(entry, "gid")
    sizes = spans.groupBy("token", "root").agg(F.sum("n").alias("n"))
    top = sizes.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1").select("token", "top")
    open_ = stash.put(spans.join(top, "token"))
    x, y = open_.where("root <> top").alias("x"), open_.alias("y")
    cross = (
        x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.top")) | (F.col("x.root") < F.col("y.root"))) & _bounds(lambda k: F.col(f"x.{k}"), lambda k: F.col(f"y.{k}"), percent))
        .select(F.col("x.gid").alias("ga"), F.col("x.root").alias("ra"), F.col("y.gid").alias("gb"), F.col("y.root").alias("rb"))
        .distinct()
    )
    pa_, pb_ = placed.select(F.col("gid").alias("ga"), F.col("root").alias("ra"), F.col("cid").alias("a")), placed.select(F.col("gid").alias("gb"), F.col("root").alias("rb"), F.col("cid").alias("b"))
    rest = cross.join(pa_, ["ga", "ra"]).join(pb_, ["gb", "rb"]).select("a", "b")
    within = placed.alias("p").join(placed.alias("q"), (F.col("p.gid") == F.col("q.gid")) & (F.col("p.cid") < F.col("q.cid")) & (F.col("p.root") != F.col("q.root"))).select(F.col("p.cid").alias("a"), F.col("q.cid").alias("b"))
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = rest.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = stash.put(_sifted(rest, classes, percent))
    if rest.limit(1).count():
        more = stash.put(_checked(rest, classes, src, stash, n, percent))
        if more.limit(1).count():
            roots = components(links.unionByName(more), stash)

    if roots is None:
        roots = classes.select(F.col("cid").alias("node"), F.col("cid").alias("root"))
    return _named(members, roots.select(F.col("node").alias("cid"), "root"), classes, key)


def _sifted(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    x, y = (classes.select(F.col("cid").alias(c), F.col("size").alias(f"s{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb", "bitsa", "bitsb").mapInArrow(_possible(percent), "a long, b long")


def _checked(pairs: DataFrame, classes: DataFrame, src: DataFrame, stash: Stash, n: int, percent: int) -> DataFrame:
    """Pairs whose whole sets link.

    The end of a pair that takes part in more pairs is the centre of a star;
    stars of many members are cut into pieces, each with its centre.  Sets are
    shuffled once, to their stars, and only those that some pair names.
    """
    ends = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).groupBy("cid").count()
    na, nb = ends.select(F.col("cid").alias("a"), F.col("count").alias("na")), ends.select(F.col("cid").alias("b"), F.col("count").alias("nb"))
    turned = pairs.join(na, "a").join(nb, "b").select(F.when(F.col("na") >= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("na") >= F.col("nb"), F.col("b")).otherwise(F.col("a")).alias("b"), F.greatest("na", "nb").alias("n"))
    turned = stash.put(turned.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR)).cast("int").alias("salt")))
    part = turned.select(F.col("b").alias("cid"), F.struct("a", "salt", F.lit(True).alias("other")).alias("star")).unionByName(turned.select(F.col("a").alias("cid"), F.struct("a", "salt", F.lit(False).alias("other")).alias("star")).distinct())
    named = part.groupBy("cid").agg(F.collect_list("star").alias("stars")).join(classes.select("cid", "doc"), "cid")
    sets = src.join(named, src["doc"].eqNullSafe(named["doc"])).select("text", "cid", "stars").mapInArrow(_set_rows(n), "a long, salt int, other boolean, cid long, shingles binary")
    return sets.repartition("a", "salt").sortWithinPartitions("a", "salt", "other").mapInArrow(_verify(percent), "a long, b long")


def _named(members: DataFrame, roots: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """The least key of each component, given to all its documents."""
    of = classes.select("cid", "doc").join(roots, "cid", "left").select("cid", F.coalesce("root", "cid").alias("root"), "doc")
    name = of.groupBy("root").agg(F.min("doc").getField("id").alias("component"))
    to = of.join(name, "root").select("cid", "component")
    return members.join(to, "cid", "left").select(F.col("doc.id").alias(key), F.col("size").cast("long").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc.id")).otherwise(F.col("component")).alias("component_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """One document of each class, that with the least key, with all its columns.

    Documents without words are linked with nothing and stay, as do classes
    without a key.  Of rows that repeat both key and text one stays; rows that
    share a key but not the text stay each unless their class has a lesser key.
    """
    named = linked_classes(docs, key, text, n, percent)
    stash = Stash(docs.sparkSession)
    going = stash.put(named.where(~F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("__gone")).distinct())
    again = docs.groupBy(key).count().where("count > 1").select(F.col(key).alias("__again"))
    kept = docs.join(going, docs[key].eqNullSafe(going["__gone"]), "left_anti")
    if not again.limit(1).count():
        return kept
    again = stash.put(again)
    once = kept.join(again, kept[key].eqNullSafe(again["__again"]), "left_anti")
    return once.unionByName(kept.join(again, kept[key].eqNullSafe(again["__again"]), "left_semi").dropDuplicates([key, text]))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id AND e.b > r.root)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.root) AS component_id FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n
"""
