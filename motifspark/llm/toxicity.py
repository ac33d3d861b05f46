"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = logistic(w . x - threshold_k), with one weight vector for all thresholds. Features are hashed
words and hashed word beginnings of 4 and 5 bytes, counted in the whole text. Only features whose share of toxic
texts differs from that of clean ones beyond chance are used (likelihood ratio, 5 % over all features together), so
a few labels give few features and no model of noise. Labels are 0 or 1 only; for three grades of severity, the
toxic training texts are parted into thirds by their evidence, the sum of the log odds of their features. The fit
sees a bounded sample (``toxic`` and ``clean`` rows by hash order, documented parameters); scoring uses whole texts
of all rows. Expected severity is the sum of the P(grade >= k).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, rows_of, slices, stage, text_buffers

BUCKETS = 1 << 20
GRADES = 3
_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[ord("a") : ord("z") + 1] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word (runs of letters; A-Z lowered) and of its beginnings."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = _LETTER[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashed = RangeHash(low)
    doc = np.searchsorted(off, s, "right") - 1
    docs, out = [doc], [hashed(s, e)]
    for n in (4, 5):
        ok = e - s > n
        docs.append(doc[ok])
        out.append(hashed(s[ok], s[ok] + n) + np.uint64(n))
    return np.concatenate(docs), (np.concatenate(out) >> np.uint64(64 - 20)).astype(np.int64)


def _listed(batches):
    for b in rows_of(batches):
        data, off = text_buffers(b.column("text"))
        for i, j in slices(off):
            doc, feature = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
            both, count = np.unique(doc * BUCKETS + feature, return_counts=True)
            doc = both // BUCKETS
            ids = b.column("doc_id").slice(i, j - i).take(pa.array(doc))
            labels = b.column("label").slice(i, j - i).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(both % BUCKETS), pa.array(count)], ["doc_id", "label", "feature", "n"])


class Ordinal:
    """Weights of the features that have one, and ordered thresholds."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.weights, self.thresholds = features, weights, thresholds

    def table(self) -> np.ndarray:
        t = np.zeros(BUCKETS)
        t[self.features] = self.weights
        return t

    def severity(self, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected severity, probability of grade 1 or more)."""
        p = 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds[None], -60, 60)))
        return p.sum(1), p[:, 0]


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, steps: int = 400, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of a cumulative-link model, by gradient steps with momentum and per-weight scales.

    Thresholds are a first one and positive gaps, so they stay in order.
    """
    n = len(grades)
    w = np.zeros(width)
    first, gaps = 1.0, np.zeros(GRADES - 1)
    above = (grades[:, None] >= np.arange(1, GRADES + 1)[None]).astype(float)
    share = np.bincount(grades > 0, minlength=2) / n
    importance = np.where(grades > 0, 0.5 / max(share[1], 1e-9), 0.5 / max(share[0], 1e-9)) / n
    m = np.zeros(width + GRADES)
    v = np.zeros(width + GRADES)
    for step in range(1, steps + 1):
        thresholds = first + np.concatenate([[0], np.cumsum(np.log1p(np.exp(gaps)))])
        eta = np.bincount(rows, values * w[cols], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(eta[:, None] - thresholds[None], -30, 30)))
        error = (p - above) * importance[:, None]
        by_row = error.sum(1)
        gw = np.bincount(cols, values * by_row[rows], minlength=width) + ridge * w / width
        gt = -error.sum(0)
        later = np.cumsum(gt[::-1])[::-1]
        g = np.concatenate([gw, [later[0]], later[1:] / (1 + np.exp(-gaps))])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
        w -= move[:width]
        first -= move[width]
        gaps -= move[width + 1 :]
    return w, first + np.concatenate([[0], np.cumsum(np.log1p(np.exp(gaps)))])


def telling(found: DataFrame, toxic: int, clean: int) -> DataFrame:
    """(feature, odds, g) of ``found`` (label, feature), one row for each text and feature: log odds of a toxic text to a clean
    one, and the likelihood ratio of that feature against chance, where it is over the bar for all features together."""
    by = stage(found.groupBy("feature").agg(F.sum(F.col("label").cast("double")).alias("a"), F.sum((F.lit(1) - F.col("label")).cast("double")).alias("b")), "toxicity-counts")
    bar = 2 * np.log(20 * max(1, by.count()))
    a, b, share = F.col("a"), F.col("b"), toxic / (toxic + clean)
    f = a + b
    cells = ((a, f * share), (b, f * (1 - share)), (toxic - a, toxic - f * share), (clean - b, clean - f * (1 - share)))
    g = sum((F.when(x > 0, x * F.log(x / e)).otherwise(0.0) for x, e in cells), F.lit(0.0)) * 2
    odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    return by.select("feature", odds.alias("odds"), g.alias("g")).filter(F.col("g") > float(bar))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = 2000, clean: int = 4000, keep: int = 3000, name: str = "toxicity") -> Ordinal:
    """A model from labels (doc_id, toxic: 0 or 1) of ``docs``.

    toxic, clean: rows of each label that the fit sees at most, by hash order of doc_id. keep: features at most, those
    that tell most. Null labels and null ids are passed over; a doc_id with both labels counts as toxic, and a repeated
    doc_id is one text with the features of all its rows. Null and empty texts have no features. Without toxic rows, or
    without a feature that tells, nothing is toxic.
    """
    none = Ordinal(np.zeros(0, np.int64), np.zeros(0), np.array([20.0, 21.0, 22.0]))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    known = known.join(own.select("doc_id"), "doc_id", "left_semi")
    order = (F.xxhash64("doc_id", F.lit(8)), F.col("doc_id"))
    chosen = stage(known.filter("label = 1").orderBy(*order).limit(toxic).unionByName(known.filter("label = 0").orderBy(*order).limit(clean)), f"{name}-chosen")
    ids = {r["doc_id"]: (i, r["label"]) for i, r in enumerate(chosen.orderBy("doc_id").collect())}
    label = np.array([y for _, y in ids.values()], np.int64)
    if not label.any():
        return none
    listed = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(_listed, "doc_id long, label int, feature long, n long")
    found = stage(listed.groupBy("doc_id", "label", "feature").agg(F.sum("n").alias("n")), f"{name}-features")
    best = telling(found, int(label.sum()), int((1 - label).sum()))
    picked = {r["feature"]: r["odds"] for r in best.orderBy(F.desc("g"), "feature").limit(keep).collect()}
    if not picked:
        return none
    features = np.array(sorted(picked), np.int64)
    odds = np.array([picked[f] for f in features.tolist()])
    kept = found.join(F.broadcast(docs.sparkSession.createDataFrame([(f,) for f in features.tolist()], "feature long")), "feature")
    rows = kept.select("doc_id", "feature", "n").orderBy("doc_id", "feature").toArrow()
    r = np.array([ids[d][0] for d in rows.column("doc_id").to_pylist()], np.int64)
    f, n = np.searchsorted(features, rows.column("feature").to_numpy()), np.log1p(rows.column("n").to_numpy())
    evidence = np.bincount(r, n * odds[f], minlength=len(ids))
    cuts = np.quantile(evidence[label > 0], np.arange(1, GRADES) / GRADES)
    grades = np.where(label > 0, 1 + (evidence[:, None] > cuts[None]).sum(1), 0)
    return Ordinal(features, *fit_ordinal(r, f, n, grades, len(features)))


def _scored(model, kept: list[str], body: str):
    def run(batches):
        own = model.value
        known = own.table()
        marks = known != 0
        for b in rows_of(batches):
            data, off = text_buffers(b.column(body))
            out = []
            for i, j in slices(off):
                doc, feature = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                hit = marks[feature]
                both, count = np.unique(doc[hit] * BUCKETS + feature[hit], return_counts=True)
                out.append(np.bincount(both // BUCKETS, np.log1p(count) * known[both % BUCKETS], minlength=j - i))
            severity, p = own.severity(np.concatenate(out))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(severity), pa.array(p)], [*kept, "severity", "p_toxic"])

    return run


def score(docs: DataFrame, model: Ordinal, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with severity (expected grade, 0 to 3), p_toxic and rejected (p_toxic >= threshold).

    Null texts count as empty; an empty text has no feature and the severity that the thresholds alone give. Very long
    texts are taken whole. Columns with the new names are replaced. Repeated rows get equal values. No rows in: no rows out.
    """
    plain = docs.drop("severity", "p_toxic", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = plain.withColumn("__body", F.coalesce(F.col(text), F.lit("")))
    schema = ", ".join(f"`{c}` {t}" for c, t in plain.dtypes) + ", severity double, p_toxic double"
    return rows.mapInArrow(_scored(shared, plain.columns, "__body"), schema).withColumn("rejected", F.col("p_toxic") >= threshold)
