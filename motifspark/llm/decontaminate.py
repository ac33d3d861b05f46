"""Benchmark decontamination with a positional inverted index of the training texts.

1. Every task turns its texts into shards of the index: for each word that the items use, the sorted places where it
   stands. The index is a table in the shared folder; a shard is a row, so a very common word is spread
   over all shards and no list is ever gathered.
2. Occurrences of each word are summed over all shards; they order the words of every window from the rarest on.
3. For each window a shard takes the list of its rarest word and intersects it with the lists of the others, each list
   less its word's place in the window: what is left are the starts of the phrase. For proximity, a place of the rarest
   word stays while every other word has a place near enough, and the covers around it are then measured.

Windows are the items' runs of ``window`` consecutive words; an item with fewer is one window.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, rows_of, stage, text_buffers
from .terms import Asked, asked_groups, numbered

#: Bytes of text in a shard of the index, about.
SHARD_BYTES = 8 << 20


_INDEX = "ids array<long>, rids array<long>, lengths array<long>, terms array<int>, counts array<long>, places array<long>"


def _indexed(shared, gap: int):
    """Shards of the index: ids, keys and lengths of their documents; words, counts and places (as differences) of the lists."""
    names = ["ids", "rids", "lengths", "terms", "counts", "places"]

    def run(batches):
        vocabulary = shared.value
        ids, rids, found, size = [], [], [], 0

        def flush():
            lengths = np.array([len(x) for x in found], np.int64)
            starts = np.cumsum(lengths + gap) - lengths - gap
            tokens = np.concatenate(found)
            at = np.arange(len(tokens)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
            at, tokens = at[tokens >= 0], tokens[tokens >= 0]
            order = np.argsort(tokens, kind="stable")
            terms, counts = np.unique(tokens, return_counts=True)
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            places = np.diff(at[order], prepend=0).astype(np.int64)
            return pa.RecordBatch.from_arrays([one(ids, pa.int64()), one(rids, pa.int64()), one(lengths, pa.int64()), one(terms, pa.int32()), one(counts, pa.int64()), one(places, pa.int64())], names)

        for b in rows_of(batches):
            data, off = text_buffers(b.column("text"))
            raw, keys, own = data.tobytes(), b.column("rid").to_pylist(), b.column("id").to_pylist()
            for k in range(b.num_rows):
                s, e = int(off[k]), int(off[k + 1])
                ids.append(own[k])
                rids.append(keys[k])
                found.append(numbered(raw[s:e], vocabulary))
                size += e - s + 256
                if size > SHARD_BYTES:
                    yield flush()
                    ids, rids, found, size = [], [], [], 0
        if rids:
            yield flush()

    return run


class Lists:
    """Posting lists of a shard by word."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, size: int):
        self.at = np.zeros(size + 1, np.int64)
        self.at[terms + 1] = counts
        self.at = np.cumsum(self.at)
        self.places = np.cumsum(places)

    def __getitem__(self, t: int) -> np.ndarray:
        return self.places[self.at[t] : self.at[t + 1]]

    def holds(self, t: int, wanted: np.ndarray) -> np.ndarray:
        own = self[t]
        at = np.searchsorted(own, wanted)
        return (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == wanted)

    def phrase(self, window: tuple[int, ...], order: list[int]) -> np.ndarray:
        """Starts of the window, by intersection from the place in it that comes first in ``order``."""
        starts = self[window[order[0]]] - order[0]
        for o in order[1:]:
            if not len(starts):
                break
            starts = starts[self.holds(window[o], starts + o)]
        return starts

    def near(self, window: tuple[int, ...], order: list[int], within: int) -> set[tuple[int, int]]:
        """Least spans [start, end) of at most ``within`` words that hold the window's words in any order, repeats included."""
        need = Counter(window)
        distinct = list(dict.fromkeys(window[o] for o in order))
        around = self[distinct[0]]
        for t in distinct[1:]:
            own = self[t]
            around = around[np.searchsorted(own, around + within) > np.searchsorted(own, around - within + 1)]
        out = set()
        for p in around:
            hits = []
            for t in distinct:
                own = self[t]
                hits += ((int(x), t) for x in own[np.searchsorted(own, p - within + 1) : np.searchsorted(own, p + within)])
            hits.sort()
            have, lacking, first = Counter(), len(window), 0
            for at, t in hits:
                have[t] += 1
                lacking -= have[t] <= need[t]
                while have[hits[first][1]] > need[hits[first][1]]:
                    have[hits[first][1]] -= 1
                    first += 1
                if not lacking and at - hits[first][0] < within:
                    out.add((hits[first][0], at + 1))
        least, end = set(), float("inf")
        for s, e in sorted(out, key=lambda x: (-x[0], x[1])):
            if e < end:  # else it holds a span that starts later, or as late, and ends no later
                least.add((s, e))
                end = e
        return least


def windows_of(asked: Asked, window: int) -> dict[tuple[int, ...], list[int]]:
    """Distinct windows and the items that have them."""
    out: dict[tuple[int, ...], dict[int, None]] = {}
    for k, terms in enumerate(asked.terms):
        own = tuple(int(t) for t in terms)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            out.setdefault(own[i : i + window], {})[k] = None
    return {w: list(ks) for w, ks in out.items()}


def _matched(shared, gap: int, size: int, within: int | None):
    names = ["rid", "item", "kind", "first", "last"]

    def run(batches):
        windows = shared.value
        words = np.array([w[0] for w, _, _ in windows], np.int32)
        for b in rows_of(batches):
            for k in range(b.num_rows):
                cell = lambda c: b.column(c)[k].values.to_numpy()  # noqa: B023, E731
                rids, lengths = cell("rids"), cell("lengths")
                lists = Lists(cell("terms"), cell("counts"), cell("places"), size)
                starts = np.cumsum(lengths + gap) - lengths - gap
                present = np.diff(lists.at) > 0
                rows = []
                # the first word here is the rarest of the window
                for i in np.flatnonzero(present[words]) if len(windows) else ():
                    _, (window, order), items = windows[i]
                    if not present[list(window)].all():
                        continue
                    exact = lists.phrase(window, order)
                    spans = [("phrase", int(s), int(s) + len(window)) for s in exact]
                    if within is not None:
                        spans += (("near", s, e) for s, e in lists.near(window, order, within))
                    for kind, s, e in spans:
                        doc = int(np.searchsorted(starts, s, "right")) - 1
                        rows.extend((rids[doc], item, kind, s - starts[doc], e - starts[doc]) for item in items)
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names)

    return run


def _match_group(rows: DataFrame, asked: Asked, window: int, within: int | None) -> tuple[DataFrame, DataFrame]:
    """The index, and (rid, item_id as text, kind, first, last) for one group of items; places count words from 0, last is exclusive."""
    spark = rows.sparkSession
    gap, size = max(window, within or 0), len(asked.vocabulary)
    index = rows.mapInArrow(_indexed(spark.sparkContext.broadcast(asked.vocabulary), gap), _INDEX)
    index = stage(index, "decontaminate-index")
    often = np.zeros(size, np.int64)
    summed = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("c"))
    for r in summed.collect():  # at most the vocabulary of the items
        often[r["terms"]] = r["c"]
    windows = []
    for w, items in windows_of(asked, window).items():
        order = sorted(range(len(w)), key=lambda o: (often[w[o]], w[o], o))  # noqa: B023
        windows.append(((w[order[0]],), (w, order), items))
    found = index.mapInArrow(_matched(spark.sparkContext.broadcast(windows), gap, size, within), "rid long, item int, kind string, first long, last long")
    names = spark.createDataFrame([(k, "" if i is None else str(i)) for k, i in enumerate(asked.ids)], "item int, item_id string")
    return index, found.join(F.broadcast(names), "item").select("rid", "item_id", "kind", "first", "last")  # ids of one group of items


def _found(docs, items, id, text, item_id, item_text, window, within) -> tuple[DataFrame, DataFrame]:
    """(id, rid, n_words) of every row, and the matches by rid of all groups of items."""
    own = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = own.withColumn("rid", row_key("id", "text"))
    groups = [_match_group(rows, asked, window, within) for asked in list(asked_groups(items, item_id, item_text)) or [Asked([])]]
    each = groups[0][0].select(F.explode(F.arrays_zip("ids", "rids", "lengths")).alias("x"))
    return each.select(F.col("x.ids").alias("id"), F.col("x.rids").alias("rid"), F.col("x.lengths").alias("n_words")), reduce(DataFrame.unionByName, (m for _, m in groups))


def matches(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, within: int | None = None) -> DataFrame:
    """(doc_id, item_id, kind, first, last): where windows of the items stand in the documents, in words from 0, last exclusive.

    kind "phrase": the window's words in a row. With ``within`` (at least ``window``), also kind "near": the least spans of at
    most that many words that hold all words of a window in any order, repeats included; no such span of a window holds
    another. Rows of one id and equal text are found once. For nulls, long texts and other columns see ``decontaminate``.
    """
    if within is not None and within < window:
        raise ValueError("within must be at least the window")
    rows, found = _found(docs, items, id, text, item_id, item_text, window, within)
    named = found.distinct().join(rows.select("rid", F.col("id").alias("doc_id")).distinct(), "rid")
    return named.select("doc_id", "item_id", "kind", "first", "last")


def decontaminate(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside an occurrence of a window), items, n_items, contaminated.

    ``items`` holds the ids, as texts in ascending order, of the items with a window in the document; an item whose id is
    null is the empty text, and rows of ``items`` with one id are one item. Null and empty texts have no words: such
    documents have no hits and such items no windows. Very long texts are read whole. Repeated rows get equal results.
    Other columns are not used, whatever their names. No documents: no rows; no items: no hits.
    """
    rows, found = _found(docs, items, id, text, item_id, item_text, window, None)
    of = found.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    grown = lambda a, x: F.struct((a["n"] + F.greatest(x["last"] - F.greatest(x["first"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["last"]).alias("end"))
    met = rows.join(of.select("rid", F.aggregate("spans", zero, grown)["n"].alias("n_hit"), "items"), "rid", "left")
    hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return met.select(F.col("id").alias("doc_id"), "n_words", hit.alias("n_hit"), names.alias("items"), F.size(names).cast("long").alias("n_items"), (hit > 0).alias("contaminated"))
