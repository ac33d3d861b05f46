"""Nearest neighbours by a vantage-point tree in each shard.

Every shard holds every vector dealt to it (nothing is sampled); queries of a block walk the tree together.
The far side of a node is visited where the distance to its sphere is within ``factor`` times a query's
tenth best so far: factor 1 is the triangle inequality and exact, less prunes more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import matrix, result, searched, valid_vectors

LEAF = 48


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances, from differences (no cancellation)."""
    out = np.empty((len(queries), len(vectors)))
    for i in range(0, len(queries), 256):
        d = queries[i : i + 256, None, :] - vectors[None]
        out[i : i + 256] = np.sqrt(np.einsum("qvd,qvd->qv", d, d))
    return out


def build(vectors: np.ndarray, rows: np.ndarray, seed: int = 7):
    """A node: (vantage row, radius, inside, outside), or the rows of a leaf."""
    if len(rows) <= LEAF:
        return rows
    pick = (seed * 2654435761) % len(rows)
    point, rest = rows[pick], np.delete(rows, pick)
    far = distances(vectors[point : point + 1], vectors[rest])[0]
    radius = float(np.median(far))
    inside = far <= radius
    if inside.all():  # more than half at one distance: repeated vectors
        half = len(rest) // 2
        inside = np.arange(len(rest)) < half
        return (point, float("nan"), build(vectors, rest[:half], seed + 1), build(vectors, rest[half:], seed + 2))
    return (point, radius, build(vectors, rest[inside], 2 * seed + 1), build(vectors, rest[~inside], 2 * seed + 2))


class Best:
    """The k nearest of each query so far, ties to smaller ids."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int):
        self.queries, self.own, self.k = queries, own, k
        self.d = np.full((len(queries), k), np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        d = np.where(ids[None] == self.own[q][:, None], np.inf, d)
        hit = (d <= self.d[q, -1:]).any(1)
        if not hit.any():
            return
        q, d = q[hit], d[hit]
        both = np.concatenate([self.d[q], d], 1)
        name = np.concatenate([self.ids[q], np.broadcast_to(ids, d.shape)], 1)
        order = np.lexsort((name, both), axis=1)[:, : self.k]
        self.d[q], self.ids[q] = np.take_along_axis(both, order, 1), np.take_along_axis(name, order, 1)


def walk(node, q: np.ndarray, best: Best, vectors: np.ndarray, ids: np.ndarray, factor: float) -> None:
    if not len(q):
        return
    if isinstance(node, np.ndarray):
        best.add(q, distances(best.queries[q], vectors[node]), ids[node])
        return
    point, radius, inside, outside = node
    d = distances(best.queries[q], vectors[point : point + 1])
    best.add(q, d, ids[point : point + 1])
    d = d[:, 0]
    if radius != radius:
        walk(inside, q, best, vectors, ids, factor)
        walk(outside, q, best, vectors, ids, factor)
        return
    near = d <= radius
    walk(inside, q[near], best, vectors, ids, factor)
    walk(outside, q[~near], best, vectors, ids, factor)
    # a hair is added so that rounding never prunes a tie
    reach = np.abs(d - radius) <= factor * best.d[q, -1] + 1e-9
    walk(outside, q[near & reach], best, vectors, ids, factor)
    walk(inside, q[~near & reach], best, vectors, ids, factor)


def _local(k: int, factor: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return result([], [], [], [])
        own, key, ids = left.column("vec_id").to_numpy(), left.column("query").to_numpy(), right.column("vec_id").to_numpy()
        vectors = matrix(right.column("v"))
        best = Best(matrix(left.column("v")), own, k)
        walk(build(vectors, np.arange(len(ids))), np.arange(len(own)), best, vectors, ids, factor)
        q, at = np.nonzero(np.isfinite(best.d))
        return result(own[q], key[q], best.ids[q, at], best.d[q, at])

    return run


def nearest(table: DataFrame, is_query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 10, factor: float = 1.0, shard_rows: int = 8192, block_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of every query row, by Euclidean distance in doubles.

    Candidates are all rows but those with the query's own id; ties go to the smaller id; with fewer than k
    candidates all are returned. Rows whose id is null or whose vector is null, empty, zero or holds null or
    non-finite components take no part. Repeated rows are candidates each, and one query together; query rows with
    one id and other vectors have k rows each. An empty table gives no rows. Other columns are not used.
    """
    rows = valid_vectors(table.filter(F.col(id).isNotNull()), vector, zero=False)
    base = rows.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    queries = rows.filter(is_query).select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return searched(base, queries, _local(k, factor), k, True, shard_rows, block_rows, "double")
