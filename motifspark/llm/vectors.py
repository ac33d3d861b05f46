"""What both vector searches share: valid rows, shards against query blocks, and the last merge."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_vectors(table: DataFrame, vector: str, zero: bool = True) -> DataFrame:
    """(id column first) rows whose vector is not null or empty and has finite components only; zero: keep zero vectors."""
    v = F.col(vector)
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero:
        ok = ok & F.exists(v, lambda x: x != 0)
    return table.filter(F.coalesce(ok, F.lit(False)))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one length as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def searched(base: DataFrame, queries: DataFrame, local, k: int, ascending: bool, shard_rows: int, block_rows: int, kind: str) -> DataFrame:
    """k best (query_id, rank, vec_id, score) over all shards.

    base, queries: (vec_id, v). Every shard of vectors meets every block of queries once, in one task of at
    most about shard_rows and block_rows rows; ``local(queries, vectors)`` gives each query's best there, so
    what the merge sorts is k rows for each query and shard. Shards and blocks of one size copy least: n vectors and
    m queries move n * m * (1 / shard_rows + 1 / block_rows) rows. Vectors meet queries of equal length only.
    Query rows with one id and one vector are one query; with one id and other vectors each is its own, and has k rows.
    """
    asked = queries.groupBy("vec_id", "v").agg(F.xxhash64(F.first("vec_id"), F.first("v")).alias("query"))
    n, m = base.count(), queries.count()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(m / block_rows))
    dim = F.size("v").alias("dim")
    left = asked.select("vec_id", "v", "query", dim, F.pmod("query", F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    right = base.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v"), dim, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).alias("shard"))
    keys = ["dim", "block", "shard"]
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(local, f"query_id long, query long, vec_id long, score {kind}")
    score = F.col("score") if ascending else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(score, "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def result(query_ids, queries, vec_ids, scores, kind=pa.float64()) -> pa.Table:
    names = ["query_id", "query", "vec_id", "score"]
    return pa.table([pa.array(query_ids, pa.int64()), pa.array(queries, pa.int64()), pa.array(vec_ids, pa.int64()), pa.array(scores, kind)], names=names)
