"""Nearest vectors by cosine, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Asked and other vectors of a pair of blocks: each row is sent once for each block of the other side.
ASKED, BLOCK = 8192, 32768
#: Asked and other vectors of one product.
ROWS, COLUMNS = 256, 4096


def dealt(vectors: DataFrame, name: str, size: int) -> tuple[DataFrame, int]:
    """``<name>, id, v``: blocks of about ``size`` vectors (``id, v``), by hash of the id, and their number."""
    n = max(1, -(-vectors.count() // size))
    return vectors.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name), "id", "v"), n


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """IDs and vectors in order of the IDs."""
    if t["v"].null_count or t["v"].combine_chunks().flatten().null_count:
        raise ValueError("a vector is null or holds a null")
    ids = t["id"].to_numpy()
    v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], v[order]


def _best(asked: np.ndarray, a: np.ndarray, ids: np.ndarray, b: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``asked`` and ``ids`` and cosines of the best ``k`` of each asked vector; ties by place.

    Product after product only what reaches the k-th best so far goes on, so no product is sorted.
    """
    unit = lambda x: np.divide(x, n := np.sqrt((x * x).sum(1, keepdims=True)), out=np.zeros_like(x), where=n > 0)
    a, b = unit(a), unit(b)
    out = []
    for r in range(0, len(a), ROWS):
        some = a[r : r + ROWS]
        least = np.full(len(some), -np.inf)
        row, col, cos = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for c in range(0, len(b), COLUMNS):
            p = some @ b[c : c + COLUMNS].T
            if p.shape[1] > k + 1:  # the k-th best but itself is k + 1 down at most
                least = np.maximum(least, np.round(np.partition(p, -k - 1, axis=1)[:, -k - 1], digits)) if c == 0 else least
            x, y = np.nonzero(p >= (least - 10.0**-digits)[:, None])
            own = asked[r + x] == ids[c + y]
            x, y = x[~own], y[~own]
            row, col, cos = np.concatenate([row, x]), np.concatenate([col, c + y]), np.concatenate([cos, np.round(p[x, y], digits)])
            order = np.lexsort((col, -cos, row))
            row, col, cos = row[order], col[order], cos[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, cos, nth = row[nth < k], col[nth < k], cos[nth < k], nth[nth < k]
            full = nth == k - 1
            least[row[full]] = cos[full]
        out.append((r + row, col, cos))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def top_k(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """``query_id, id, cosine`` of the ``k`` most similar other vectors of each query; ties by id.

    Blocks of queries meet blocks of vectors under an equality key, each pair in
    one task by products of bounded size, and only its ``k`` best per query go on.
    Vectors travel as rows, so that no row holds a block.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    (q, nq), (v, nv) = dealt(queries, "qb", ASKED), dealt(vectors, "vb", BLOCK)
    left = q.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1)))).groupBy("qb", "vb")
    right = v.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).groupBy("qb", "vb")
    names = ["query_id", "id", "cosine"]

    def run(asked: pa.Table, others: pa.Table) -> pa.Table:
        if not len(asked) or not len(others):
            return pa.table([pa.array([], t) for t in (asked.schema.field("id").type if len(asked) else others.schema.field("id").type, others.schema.field("id").type, pa.float64())], names=names)
        (x, a), (ids, b) = _matrix(asked), _matrix(others)
        row, col, cos = _best(x, a, ids, b, k, digits)
        return pa.table([x[row], ids[col], cos], names=names)

    near = left.cogroup(right).applyInArrow(run, f"query_id {kind}, id {kind}, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
