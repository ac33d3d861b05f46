"""Ranked lexical search with geometric blocks in the posting lists.

Documents are searched in shards. In a shard, each posting list that a query reaches is clustered by document
similarity: documents have a short projection of their weights, evenly spaced members of the list are centres,
and every member joins the centre it is most similar to. A block keeps a summary: for each term the largest
weight that any of its documents has. The summary's product with the query bounds the score of every
document in the block, so a block is passed over only where this exact bound cannot reach the k-th best score.

A query reads its lists from the term with the highest weight w to that with the least. A document is met in the
first list that holds it, so in a later list only the terms from there on count in the bound, and the
query ends where the sum of the remaining lists' maxima cannot reach the k-th best score. A task carries its best
scores from shard to shard. Scores are 64-bit integers, so the result is exact, ties included.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, stage, text_buffers
from .terms import Asked, asked_groups, numbered

#: Documents searched together; members of a list for each centre; documents in a block at most; length of a projection.
SHARD, SPREAD, BLOCK, DIMS = 4096, 48, 96, 16
#: Block maxima kept at a time in a shard.
SUMMARIES = 4 << 20


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _counted(shared):
    """(id, n, terms, tfs) of each text: all its words, and those that the items ask for with their counts."""

    def run(batches):
        vocabulary = shared.value
        for b in rows_of(batches):
            data, off = text_buffers(b.column("text"))
            raw = data.tobytes()
            n, sizes, terms, tfs = [], [0], [], []
            for k in range(b.num_rows):
                got = numbered(raw[int(off[k]) : int(off[k + 1])], vocabulary)
                t, c = np.unique(got[got >= 0], return_counts=True)
                n.append(len(got))
                sizes.append(sizes[-1] + len(t))
                terms.append(t)
                tfs.append(c)
            ends = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x).astype(np.int32))) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    return run


class Shard:
    """Documents of a shard as weights by document and by term, and the blocks of its posting lists."""

    def __init__(self, ids, unknown, ends, terms, weights, size: int):
        self.ids, self.unknown, self.ends, self.terms, self.weights = ids, unknown, ends, terms, weights
        n = len(ids)
        owner = np.repeat(np.arange(n), np.diff(ends))
        order = np.argsort(terms, kind="stable")
        self.docs, self.impacts = owner[order], weights[order]
        self.at = np.searchsorted(terms[order], np.arange(size + 1))
        self.top = np.zeros(size, np.int64)
        held = np.flatnonzero(np.diff(self.at))
        if len(held):
            self.top[held] = np.maximum.reduceat(self.impacts, self.at[held])
        signs = np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (size, DIMS))
        sketch = np.zeros((n, DIMS), np.float32)
        full = np.flatnonzero(np.diff(ends))
        for i in range(0, len(full), 1024):
            part = full[i : i + 1024]
            a, z = ends[part[0]], ends[part[-1] + 1]
            # empty documents between have no postings, so the starts of the others cut the range
            sketch[part] = np.add.reduceat(weights[a:z, None].astype(np.float32) * signs[terms[a:z]], ends[part] - a)
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        self._blocks, self._maxima, self._kept = {}, {}, 0

    def list_of(self, t: int):
        return self.docs[self.at[t] : self.at[t + 1]], self.impacts[self.at[t] : self.at[t + 1]]

    def blocks(self, t: int):
        """(documents of the list of t in block order, block of each document of the shard or -1, block starts)."""
        if t not in self._blocks:
            docs, _ = self.list_of(t)
            centres = self.sketch[docs[SPREAD // 2 :: SPREAD]]
            cluster = (self.sketch[docs] @ centres.T).argmax(1) if len(centres) > 1 else np.zeros(len(docs), np.int64)
            order = np.argsort(cluster, kind="stable")
            docs, cluster = docs[order], cluster[order]
            fresh = np.ones(len(docs), bool)
            fresh[1:] = cluster[1:] != cluster[:-1]
            first = np.flatnonzero(fresh)
            fresh |= (np.arange(len(docs)) - first[np.cumsum(fresh) - 1]) % BLOCK == 0
            of = np.full(len(self.ids), -1, np.int32)
            of[docs] = np.cumsum(fresh) - 1
            self._blocks[t] = docs, of, np.append(np.flatnonzero(fresh), len(docs))
        return self._blocks[t]

    def maxima(self, t: int, c: int) -> np.ndarray:
        """Coordinate c of the summaries of the blocks of t."""
        if (t, c) not in self._maxima:
            _, of, starts = self.blocks(t)
            docs, impacts = self.list_of(c)
            out = np.zeros(len(starts) - 1, np.int64)
            at = of[docs]
            np.maximum.at(out, at[at >= 0], impacts[at >= 0])
            if self._kept > SUMMARIES:
                self._maxima, self._kept = {}, 0
            self._maxima[t, c] = out
            self._kept += len(out) + 16
        return self._maxima[t, c]

    def scores(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        a, n = self.ends[docs], self.ends[docs + 1] - self.ends[docs]
        starts = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(a - starts, n)
        return np.add.reduceat(self.weights[at] * times[self.terms[at]], starts)  # every document here has a posting


class Best:
    """The k best documents of one query so far: highest score, then least id, unknown ids last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.unknown, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores, unknown, ids):
        s, u, i = np.concatenate([self.scores, scores]), np.concatenate([self.unknown, unknown]), np.concatenate([self.ids, ids])
        order = np.lexsort((i, u, -s))[: self.k]
        self.scores, self.unknown, self.ids = s[order], u[order], i[order]


def search_shard(shard: Shard, queries: list, best: list[Best], size: int) -> int:
    """Adds to ``best`` what the shard has for each query (terms by falling w, times); the number of documents evaluated."""
    times, evaluated = np.zeros(size, np.int64), 0
    for (terms, counts), own in zip(queries, best):
        rest = np.cumsum((shard.top[terms] * counts)[::-1])[::-1]
        if not len(rest) or rest[0] < own.floor():
            continue
        times[terms] = counts
        seen = np.zeros(len(shard.ids), bool)
        for j, t in enumerate(terms):
            if rest[j] < own.floor():
                break
            if not shard.top[t]:
                continue
            docs, _, starts = shard.blocks(t)
            bound = np.zeros(len(starts) - 1, np.int64)
            for c, n in zip(terms[j:], counts[j:]):
                if shard.top[c]:
                    bound += n * shard.maxima(t, c)
            for b in np.argsort(-bound, kind="stable"):
                if bound[b] < own.floor():
                    break
                members = docs[starts[b] : starts[b + 1]]
                members = members[~seen[members]]
                if len(members):
                    seen[members] = True
                    evaluated += len(members)
                    s = shard.scores(members, times)
                    good = s >= own.floor()
                    if good.any():
                        own.add(s[good], shard.unknown[members[good]], shard.ids[members[good]])
        times[terms] = 0
    return evaluated


def _searched(shared, k: int):
    def run(batches):
        queries, w, size, documents, length = shared.value
        best = [Best(k) for _ in queries]
        held, rows = [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            n = t.column("n").to_numpy()
            lists = [t.column(c).chunk(0) for c in ("terms", "tfs")]
            ends = lists[0].offsets.to_numpy().astype(np.int64)
            terms, tf = (x.flatten().to_numpy() for x in lists)
            ends = ends - ends[0]
            m = 75 + np.array([25 * int(x) * documents // length for x in n], np.int64)  # whole numbers of any size
            tf = tf.astype(np.int64)
            weights = w[terms] * (1000000000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(ends))))
            ids = t.column("id")
            shard = Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), ends, terms, weights, size)
            search_shard(shard, queries, best, size)

        for b in rows_of(batches):
            for i in range(0, b.num_rows, SHARD):
                held.append(b.slice(i, SHARD))
                rows += held[-1].num_rows
                if rows >= SHARD:
                    flush()
                    held, rows = [], 0
        if held:
            flush()
        out = [np.concatenate(x) for x in zip(*((np.full(len(o.ids), q), o.scores, o.unknown, o.ids) for q, o in enumerate(best)))]
        if out and len(out[0]):
            q, s, u, i = out
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(i, mask=u), pa.array(s)], ["q", "doc_id", "score"])

    return run


def _search_group(docs: DataFrame, asked: Asked, item_type: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    size = len(asked.vocabulary)
    counted = docs.mapInArrow(_counted(spark.sparkContext.broadcast(asked.vocabulary)), "id long, n long, terms array<int>, tfs array<int>")
    counted = stage(counted.filter("n > 0"), "lexical-terms")
    documents, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the vocabulary of the items
        df[r["t"]] = r["count"]
    w = np.array([term_weight(documents, int(x)) for x in df], np.int64)
    queries = []
    for terms in asked.terms:
        t, n = np.unique(terms, return_counts=True)
        order = np.lexsort((t, -w[t]))
        queries.append((t[order], n[order].astype(np.int64)))
    shared = spark.sparkContext.broadcast((queries, w, size, documents, max(length, 1)))
    found = counted.filter(F.size("terms") > 0).mapInArrow(_searched(shared, k), "q int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame(list(enumerate(asked.ids)), f"q int, item_id {item_type}")
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")  # ids of one group of items


def search(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score) of the k documents that score highest for each item's words, repeats included.

    A word's weight w is floor(1000 ln((2N + 2) / (2 df + 1))); it adds w * (10^9 tf div (1000 tf + 12 m)), with m = 75 +
    25 n N div L. Only scores over 0 count; equal scores go to the smaller id, null ids last. Null and empty texts have no
    words: such items get no rows, such documents are not counted. Every row of ``docs`` is a document and every row of
    ``items`` a query, so repeated rows rank, or are answered, each. Very long texts are read whole. Other columns are not
    used, whatever their names. Empty tables give no rows. Items are read in groups of some bytes, documents once a group.
    """
    plain = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = dict(items.dtypes)[item_id]
    groups = [_search_group(plain, asked, kind, k) for asked in asked_groups(items, item_id, item_text)]
    if not groups:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, groups)
