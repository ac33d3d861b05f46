"""Exact top-k by pivot-table elimination.

For integer vectors the inner product is (|q|^2 + |v|^2 - d(q, v)^2) / 2. Each shard keeps the distances of
its vectors to its pivots; for a query, the largest |d(q, p) - d(v, p)| over the pivots is a lower bound of
d(q, v), and so an upper bound of the score. Candidates are evaluated in bound order, in blocks, until no
bound can reach the k-th best score: the result is exact, ties included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, result, searched, valid_vectors

#: Taken off every lower bound, more than single precision can be wrong by at these magnitudes (relative to the norms).
SLACK = 1e-5


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each next pivot is the row farthest from those chosen."""
    first = int(np.argmax((vectors * vectors).sum(1)))
    chosen, near = [first], np.full(len(vectors), np.inf)
    while len(chosen) < min(count, len(vectors)):
        d = vectors - vectors[chosen[-1]]
        near = np.minimum(near, np.einsum("vd,vd->v", d, d))
        if not near.max() > 0:
            break
        chosen.append(int(np.argmax(near)))
    return np.array(chosen)


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(sq, 0)).astype(np.float32)


def top(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, pivots: int, block: int = 512):
    """For each query (its number, ids, scores) of the k best, exact for integer-valued vectors."""
    chosen = vectors[choose_pivots(vectors, pivots)]
    table, asked = _to_pivots(vectors, chosen).T.copy(), _to_pivots(queries, chosen)
    norms, q_norms = (vectors * vectors).sum(1), (queries * queries).sum(1)
    slack = np.float32(SLACK * (1 + np.sqrt(max(norms.max(), q_norms.max()))) * 4)
    half = norms / 2
    for i in range(len(queries)):
        low = np.abs(table[0] - asked[i, 0])
        for p in range(1, len(table)):
            np.maximum(low, np.abs(table[p] - asked[i, p]), out=low)
        low = np.maximum(low - slack, 0).astype(np.float64)
        bound = half + q_norms[i] / 2 - low * low / 2
        bound[ids == own[i]] = -np.inf
        scores, names, floor = np.zeros(0), np.zeros(0, np.int64), -np.inf
        rest = np.arange(len(ids))
        size = block
        while len(rest):
            if len(rest) > size:
                cut = np.argpartition(-bound[rest], size)
                take, rest = rest[cut[:size]], rest[cut[size:]]
            else:
                take, rest = rest, rest[:0]
            take = take[(bound[take] >= floor) & (bound[take] > -np.inf)]
            scores, names = np.concatenate([scores, vectors[take] @ queries[i]]), np.concatenate([names, ids[take]])
            order = np.lexsort((names, -scores))[:k]
            scores, names = scores[order], names[order]
            if len(scores) == k:
                floor = scores[-1]
                rest = rest[bound[rest] >= floor]
            size *= 4
        yield i, names, scores


def _local(k: int, pivots: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return result([], [], [], [], pa.int64())
        own, key, ids = left.column("vec_id").to_numpy(), left.column("query").to_numpy(), right.column("vec_id").to_numpy()
        q, h, n, s = [], [], [], []
        for i, names, scores in top(matrix(left.column("v")), own, matrix(right.column("v")), ids, k, pivots):
            q.append(np.full(len(names), own[i]))
            h.append(np.full(len(names), key[i]))
            n.append(names)
            s.append(np.rint(scores).astype(np.int64))
        return result(np.concatenate(q), np.concatenate(h), np.concatenate(n), np.concatenate(s), pa.int64())

    return run


def top_inner_products(table: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, k: int = 20, pivots: int = 16, shard_rows: int = 8192, block_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of every query row with all others.

    Components become floor(scale * x), x as double. Candidates are all rows but those with the query's own id;
    ties go to the smaller id; with fewer than k candidates all are returned. Rows whose id is null or whose
    vector is null, empty or holds null or non-finite components take no part; zero vectors do. Sums are exact
    while they stay under 2**53. Repeated rows are candidates each, and one query together; query rows with one id
    and other vectors have k rows each. An empty table gives no rows. Other columns are not used.
    """
    rows = valid_vectors(table.filter(F.col(id).isNotNull()), vector)
    whole = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    base = rows.select(F.col(id).cast("long").alias("vec_id"), whole.alias("v"))
    queries = rows.filter(is_query).select(F.col(id).cast("long").alias("vec_id"), whole.alias("v"))
    return searched(base, queries, _local(k, pivots), k, False, shard_rows, block_rows, "long")
