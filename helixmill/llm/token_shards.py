"""Token IDs in training order: fixed-stride binary shards at slots of a keyed permutation.

1. Documents are put in one total order that follows from their rows alone: by
   a keyed 60-bit hash of key and text, then key, text and nothing else (rows
   equal in both are interchangeable).  The hash space is cut into equal ranges,
   one per partition; partitions are sorted.  So the order of sequences is the
   same however the input is split and however many partitions there are.
2. Each document is encoded with a public byte-pair vocabulary, closed by the
   end-of-text ID and cut into sequences of ``LENGTH`` IDs; the last is padded
   with that ID.  The sequences are written once, in order; sequences before a
   file plus the place in the file is a dense index.
3. A keyed Feistel network on the least even number of bits that holds all
   sequences, with cycle-walking back into range, maps the index to a global
   slot.
4. Slots are dealt by range into shards of ``ROWS`` records of a fixed stride;
   each shard is sorted and written as one raw file, so that a reader goes
   through the training order sequentially and resumes at any slot:
   ``shard = slot // ROWS``, ``offset = slot % ROWS * stride``.  Shards are
   dealt in ``ROUNDS_OF_SHARDS`` rounds of consecutive slots, so that only a part of
   all IDs is in the shuffle at a time.

Files are written under a temporary name first and renamed, so a task that runs
again leaves one whole file.  :func:`build` returns the manifest, one row per
shard; :func:`read_slots` reads the files back; :func:`records` gives the
records as rows instead.

Edge cases: a null or empty text is the end-of-text ID alone; repeated rows are
encoded each; a null key stays null; an empty table gives no record; other
columns are ignored.  Memory is bounded by a batch of texts and one shard; each
text is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.llm.common import Stash, maybe_broadcast

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits texts for byte-level BPE of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH = 256
ROWS = 16384
KEY = 0x5DEECE66D
ROUNDS = 6
ROUNDS_OF_SHARDS = 4
CHUNK = 4000


def vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def id_type(n: int) -> np.dtype:
    """Little-endian, two bytes where the largest ID fits."""
    return np.dtype("<u2") if n < 1 << 16 else np.dtype("<u4")


def encode(docs: DataFrame, key: str, text: str, vocab: dict[bytes, int], length: int, pattern: str = PATTERN) -> DataFrame:
    """``doc, seq, n, ids``: the IDs of each sequence, not padded."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = shared.value
        end = max(ranks.values()) + 1
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        dtype = id_type(end)
        for batch in batches:
            row, seq, n, ids = [], [], [], []

            def rows(batch=batch, row=row, seq=seq, n=n, ids=ids) -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(seq, pa.int32()), pa.array(n, pa.int32()), pa.array(ids, pa.binary())], names=["doc", "seq", "n", "ids"])
                for x in (row, seq, n, ids):
                    x.clear()
                return out

            for i, t in enumerate(batch.column(1)):
                got = enc.encode_ordinary(t.as_py()) if t.is_valid else []
                got.append(end)
                raw = np.array(got, dtype).tobytes()
                step = length * dtype.itemsize
                for s in range(0, len(raw), step):
                    row.append(i)
                    seq.append(s // step)
                    ids.append(raw[s : s + step])
                    n.append(len(ids[-1]) // dtype.itemsize)
                if len(row) >= CHUNK:
                    yield rows()
            yield rows()

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"doc {kind}, seq int, n int, ids binary")


def permute(index: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """Keyed bijection of ``0 .. total - 1``: a Feistel network, walked until it falls into range."""
    half = max(1, -(-max(total - 1, 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") | 1 for r in range(ROUNDS)]

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + np.uint64(k >> 32)) * np.uint64(k)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    x = network(index.astype(np.uint64))
    while (out := x >= total).any():
        x[out] = network(x[out])
    return x.astype(np.int64)


def ordered(docs: DataFrame, key: str, text: str, secret: int) -> DataFrame:
    """``key, text`` in the total order: hash ranges by partition, sorted inside."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    d = docs.select(k.alias("k"), t.alias("t"), F.shiftrightunsigned(F.xxhash64(F.lit(secret), k, t, t.isNull()), 4).alias("h"))
    dealt = d.repartitionById(parts, F.floor(F.col("h").cast("decimal(38,0)") * parts / F.lit(1 << 60).cast("decimal(38,0)")).cast("int"))
    return dealt.sortWithinPartitions("h", "k", "t").select("k", "t")


def placed(docs: DataFrame, stash: Stash, key: str, text: str, vocab: dict[bytes, int], length: int, secret: int) -> tuple[DataFrame, int]:
    """``slot, doc, seq, n, ids`` of every sequence, and their number."""
    spark = docs.sparkSession
    encoded = stash.put(encode(ordered(docs, key, text, secret), "k", "t", vocab, length))
    at = encoded.select("doc", "seq", "n", "ids", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("nth"))
    files = stash.put(at.groupBy("file").count())  # a row per partition that was written; file names rise with the partition
    base = files.select("file", (F.sum("count").over(Window.orderBy("file")) - F.col("count")).alias("base"))
    total = files.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]

    @F.pandas_udf("long")
    def slot(index):
        import pandas as pd

        return pd.Series(permute(index.to_numpy(), total, secret))

    return at.join(maybe_broadcast(base, 100_000), "file").select(slot(F.col("base") + F.col("nth")).alias("slot"), "doc", "seq", "n", "ids"), total


def records(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, length: int = LENGTH, rows: int = ROWS, secret: int = KEY) -> DataFrame:
    """``slot, shard, offset``, the key, ``seq, n_tokens, ids``: one fixed-stride record per sequence, partitioned by shard and in order of slots."""
    vocab = vocabulary(path)
    at, total = placed(docs, Stash(docs.sparkSession), key, text, vocab, length, secret)
    return _dealt(at, key, _stride(vocab, length), _end(vocab), rows, 0, max(1, -(-total // rows)))


def _end(vocab: dict[bytes, int]) -> bytes:
    end = max(vocab.values()) + 1
    return np.array([end], id_type(end)).tobytes()


def _stride(vocab: dict[bytes, int], length: int) -> int:
    return length * len(_end(vocab))


def _dealt(at: DataFrame, key: str, stride: int, end: bytes, rows: int, first: int, shards: int) -> DataFrame:
    """Records of ``shards`` shards from ``first`` on, a partition for each, in order of slots."""
    some = at.where((F.col("slot") >= first * rows) & (F.col("slot") < (first + shards) * rows))
    dealt = some.withColumn("shard", F.floor(F.col("slot") / rows).cast("int")).repartitionById(shards, F.col("shard") - first).sortWithinPartitions("slot")
    return dealt.select("slot", "shard", ((F.col("slot") % rows) * stride).alias("offset"), F.col("doc").alias(key), "seq", F.col("n").alias("n_tokens"), F.rpad("ids", F.lit(stride), F.lit(bytearray(end))).alias("ids"))


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", where: str | None = None, path: str = VOCABULARY, length: int = LENGTH, rows: int = ROWS, secret: int = KEY) -> DataFrame:
    """Writes the shards under the URI ``where`` (a folder of the shared one if not given) and returns their manifest.

    One row per shard: ``shard, first_slot, n_records, n_tokens, n_bytes,
    sha256``, ``file``, and ``keys``, the keys of its records in order of
    slots.  ``n_tokens`` leaves padding out.
    """
    stash = Stash(docs.sparkSession)
    vocab = vocabulary(path)
    at, total = placed(docs, stash, key, text, vocab, length, secret)
    where = where or stash.folder()
    shards = max(1, -(-total // rows))
    step = -(-shards // ROUNDS_OF_SHARDS)
    parts = [stash.put(write_shards(_dealt(at, key, _stride(vocab, length), _end(vocab), rows, first, min(step, shards - first)), where, key, rows)) for first in range(0, shards, step)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _open(where: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(where)


def write_shards(recs: DataFrame, where: str, key: str = "doc_id", rows: int = ROWS) -> DataFrame:
    """Writes ``shard-<n>.bin`` files under a URI that all executors reach; lazily returns the manifest of :func:`build`."""
    kind = recs.schema[key].dataType
    name = f"`{key}`"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, base = _open(where)
        store.create_dir(base, recursive=True)
        at = out = part = None
        n = tokens = size = 0
        digest, keys = None, []

        def done() -> pa.RecordBatch:
            out.close()
            file = f"shard-{at:06d}.bin"
            store.move(part, f"{base}/{file}")
            row = {"shard": pa.array([at], pa.int32()), "first_slot": pa.array([at * rows], pa.int64()), "n_records": pa.array([n], pa.int64()), "n_tokens": pa.array([tokens], pa.int64()), "n_bytes": pa.array([size], pa.int64()), "sha256": pa.array([digest.hexdigest()]), "file": pa.array([file])}
            held = pa.concat_arrays(keys)
            row["keys"] = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            shard = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(shard, prepend=-1 if not len(shard) or shard[0] != at else at))
            starts = np.unique(np.concatenate([[0], cut])) if len(shard) else cut
            for s, e in zip(starts, np.append(starts[1:], len(shard)), strict=True):
                if shard[s] != at:
                    if out:
                        yield done()
                    at, n, tokens, size, digest, keys, part = int(shard[s]), 0, 0, 0, hashlib.sha256(), [], f"{base}/.part-{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                raw = b"".join(x.as_py() for x in batch.column(3).slice(s, e - s))
                out.write(raw)
                digest.update(raw)
                n, tokens, size = n + int(e - s), tokens + int(batch.column(2).slice(s, e - s).to_numpy().sum()), size + len(raw)
                keys.append(batch.column(1).slice(s, e - s))
        if out:
            yield done()

    return recs.select("shard", name, "n_tokens", "ids").mapInArrow(run, f"shard int, first_slot long, n_records long, n_tokens long, n_bytes long, sha256 string, file string, keys array<{kind.simpleString()}>")


def read_slots(where: str, start: int, stop: int, length: int = LENGTH, rows: int = ROWS, dtype: str = "<u2") -> Iterator[np.ndarray]:
    """The sequences of slots ``start .. stop - 1`` in training order."""
    store, base = _open(where)
    stride = length * np.dtype(dtype).itemsize
    while start < stop:
        shard, row = divmod(start, rows)
        take = min(stop - start, rows - row)
        with store.open_input_file(f"{base}/shard-{shard:06d}.bin") as f:
            raw = f.read_at(take * stride, row * stride)
        yield from np.frombuffer(raw, dtype).reshape(-1, length)
        start += take
