"""Quality by nearest-neighbour voting in a latent-semantic space.

Labelled texts (a bounded sample, ``sample`` rows by hash order, a documented parameter) become vectors of
character-class pairs and repetition measures; a truncated singular value decomposition of them gives the
latent space. The labelled vectors, at most sample x dims numbers, are broadcast, and every text of the corpus
is compared with all of them by blocked cosine products. The nearest vote, weighted by similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, rows_of, slices, text_buffers

CLASSES, EXTRA = 40, 8
WIDTH = CLASSES * CLASSES + EXTRA


def _class_table() -> np.ndarray:
    """Class of a byte: lower case, upper case, digit, space, line end, other control, each ASCII mark, beyond ASCII."""
    t = np.full(256, 5, np.int64)
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = 0, 1, 2
    t[32], t[10], t[128:] = 3, 4, 6
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    t[marks] = 7 + np.arange(len(marks))
    return t


_CLASS = _class_table()
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of WIDTH numbers for each text: root frequencies of class pairs, then repetition measures."""
    n = len(off) - 1
    size = np.diff(off)
    out = np.zeros((n, WIDTH), np.float32)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), size)
    c = _CLASS[data]
    same = doc[1:] == doc[:-1]
    pairs = np.bincount(doc[:-1][same] * (CLASSES * CLASSES) + c[:-1][same] * CLASSES + c[1:][same], minlength=n * CLASSES * CLASSES)
    out[:, : CLASSES * CLASSES] = np.sqrt(pairs.reshape(n, -1) / np.maximum(size - 1, 1)[:, None])
    hashed = RangeHash(data)

    def repeats(gap: np.ndarray, column: int) -> None:
        """Of the units between gaps: how many equal the one before, and how many have been seen in the text."""
        solid = ~gap
        first = solid.copy()
        first[1:] &= gap[:-1] | (doc[1:] != doc[:-1])
        last = solid.copy()
        last[:-1] &= gap[1:] | (doc[1:] != doc[:-1])
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(s):
            return
        h, d = hashed(s, e), doc[s]
        count = np.maximum(np.bincount(d, minlength=n), 1)
        again = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        out[:, column] = np.sqrt(np.bincount(d[1:][again], minlength=n) / count)
        order = np.lexsort((h, d))
        twin = (h[order][1:] == h[order][:-1]) & (d[order][1:] == d[order][:-1])
        seen = np.bincount(d[order][1:][twin], minlength=n) / count
        out[:, column + 1] = seen
        out[:, column + 2] = np.minimum(np.bincount(d, e - s, minlength=n) / count / 50, 1)

    repeats(_SPACE[data], CLASSES * CLASSES)
    repeats(data == 10, CLASSES * CLASSES + 3)
    return out


class Voters:
    """Labelled latent vectors, and how a text's features become one."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, dims: int = 48, neighbours: int = 15):
        self.neighbours, self.labels = neighbours, labels.astype(np.float32)
        self.weight = np.ones(WIDTH, np.float32)
        self.basis = np.zeros((WIDTH, 0), np.float32)
        self.vectors = np.zeros((0, 0), np.float32)
        if len(rows):
            seen = (rows > 0).sum(0)
            self.weight = np.log((1 + len(rows)) / (1 + seen)).astype(np.float32) + np.float32(0.2)
            self.weight[CLASSES * CLASSES :] = 3
            x = rows * self.weight
            values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
            self.basis = vectors[:, ::-1][:, : min(dims, len(rows))].astype(np.float32)
            self.vectors = self._unit(x @ self.basis)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.ones(len(rows))
        out = np.empty(len(rows))
        x = self._unit((rows * self.weight) @ self.basis)
        k = min(self.neighbours, len(self.labels))
        for i in range(0, len(rows), 512):
            cosine = x[i : i + 512] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(cosine, near, 1)
            # a high power of the similarity, so that a close neighbour outvotes many far ones
            w = np.maximum(best.astype(np.float64), 0) ** 20 + 1e-9
            out[i : i + 512] = (w * self.labels[near]).sum(1) / w.sum(1)
            least = best.min(1)
            for r in np.flatnonzero((cosine >= least[:, None]).sum(1) > k):  # all that tie for the last place vote
                tied = cosine[r] >= least[r]
                w = np.maximum(cosine[r][tied].astype(np.float64), 0) ** 20 + 1e-9
                out[i + r] = (w * self.labels[tied]).sum() / w.sum()
        return np.clip(out, 0, 1)


def _measured(batches):
    for b in rows_of(batches):
        data, off = text_buffers(b.column("text"))
        for i, j in slices(off):
            rows = features(data[off[i] : off[j]], off[i : j + 1] - off[i]).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("label").slice(i, j - i), pa.array([r.tobytes() for r in rows], pa.binary())], ["label", "row"])


def training_rows(docs: DataFrame, labels: DataFrame, column: str, sample: int, salt: int = 1) -> DataFrame:
    """(text, label, doc_id) of at most ``sample`` labelled rows with crc32(doc_id) mod 5 not 0, by hash order.

    Where rows of ``docs`` share a doc_id, the text of least hash stands for it.
    """
    learnt = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = learnt.select("doc_id", F.col(column).cast("int").alias("label")).join(own.select("doc_id"), "doc_id", "left_semi")
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(sample)
    ids = F.broadcast(chosen.select("doc_id").distinct())  # at most ``sample`` numbers
    one = own.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("s"))
    return chosen.join(one, "doc_id").select("doc_id", F.col("s.text").alias("text"), "label")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, dims: int = 48, neighbours: int = 15) -> Voters:
    """Voters from labels (doc_id, quality: 0 or 1) of ``docs``; without any, every text scores 1.

    sample: labelled rows at most, by hash order of doc_id; none has crc32(doc_id) mod 5 = 0. Null labels and null ids are
    passed over; a row of labels is a vote, so a doc_id with both labels votes for both, and a repeated doc_id for each row.
    """
    rows = training_rows(docs, labels, "quality", sample).select("text", "label").mapInArrow(_measured, "label int, row binary").toArrow()
    if not rows.num_rows:
        return Voters(np.zeros((0, WIDTH), np.float32), np.zeros(0))
    raw = sorted(zip((r.as_py() for r in rows.column("row")), rows.column("label").to_pylist()))
    x = np.frombuffer(b"".join(r for r, _ in raw), np.float16).reshape(-1, WIDTH).astype(np.float32)
    return Voters(x, np.array([y for _, y in raw]), dims, neighbours)


def _scored(voters, kept: list[str], body: str):
    def run(batches):
        own = voters.value
        for b in rows_of(batches):
            data, off = text_buffers(b.column(body))
            out = [own.scores(features(data[off[i] : off[j]], off[i : j + 1] - off[i])) for i, j in slices(off)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(np.concatenate(out))], [*kept, "score"])

    return run


def score(docs: DataFrame, voters: Voters, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1, higher: better) and predicted (1 if score >= threshold).

    Only the text makes the score: the share of label 1 among the nearest labelled texts, weighted by similarity; all
    that tie for the last place vote. Null counts as empty. An empty text is like none, so all labelled texts vote alike.
    Very long texts are taken whole. Columns with the new names are replaced. Repeated rows get equal scores. No rows
    in: no rows out.
    """
    plain = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    rows = plain.withColumn("__body", F.coalesce(F.col(text), F.lit("")))
    schema = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes) + ", score double"
    return rows.mapInArrow(_scored(shared, plain.columns, "__body"), schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
