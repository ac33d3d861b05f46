"""A linear head over frozen vectors: multinomial regression with a validation history, and early stopping by it.

Every pass over the rows gives loss and gradient at the current weights; steps use one bound on the curvature for all
classes (half the second moments of the vectors), so the training loss never rises and no line search is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import settle
from .densejoin import _matrix, sound
from .gate import early_stop

#: Bytes of weights (classes x (dimensions + 1) doubles), or of second moments, that a task may be sent.
MOST_BYTES = 256 << 20
_ROWS = 1024


def _with_one(table: pa.Table) -> np.ndarray:
    x = _matrix(table, "v")
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def _softmax(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w.T
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _rows_of(out: list, task: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"c": pa.array(range(len(out)), pa.int32()), "task": pa.array([task] * len(out), pa.int32()), "x": pa.array(out, pa.list_(pa.float64()))})


def _summed(parts: DataFrame, fan: int = 64) -> list:
    """(c, x) summed by c; parts: (c, task, x) with arrays x. Tasks meet in groups of ``fan`` first, so no group grows with the input."""

    def add(t: pa.Table) -> pa.Table:
        total = np.sum(t.column("x").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1), axis=0)
        return pa.table({"c": t.column("c")[:1], "task": pa.array([t.column("task")[0].as_py() // fan], pa.int32()), "x": pa.array([total.tolist()], pa.list_(pa.float64()))})

    schema, tasks = "c int, task int, x array<double>", parts.rdd.getNumPartitions()
    while tasks > 1:
        parts = parts.withColumn("g", F.floor(F.col("task") / fan)).groupBy("c", "g").applyInArrow(add, schema)
        tasks = -(-tasks // fan)
    return sorted(parts.collect(), key=lambda r: r["c"])  # a row for each class


def _moments(rows: DataFrame, d: int) -> tuple[np.ndarray, int]:
    """Mean outer product of the training vectors with a one at the end, and their number."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, n = np.zeros((d + 1, d + 1)), 0
        for b in batches:
            x = _with_one(pa.Table.from_batches([b]))
            total += x.T @ x
            n += len(x)
        out = [*total.tolist(), [float(n)] * (d + 1)] if n else []
        yield _rows_of(out, TaskContext.get().partitionId())

    found = _summed(rows.filter("not held").select("v").mapInArrow(part, "c int, task int, x array<double>"))
    x = np.array([r.x for r in found])
    return x[:-1] / x[-1, 0], int(x[-1, 0])


def _pass(rows: DataFrame, w: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Gradient and mean loss over training rows, and mean loss over held rows (nan if there are none), without the penalty."""
    k, d = w.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        g, sums = np.zeros((k, d)), np.zeros(4)
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                t = pa.Table.from_batches([b.slice(at, _ROWS)])
                x, y, held = _with_one(t), t.column("c").to_numpy(), t.column("held").to_numpy(zero_copy_only=False).astype(bool)
                p = _softmax(x, w)
                loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))
                sums += [loss[~held].sum(), (~held).sum(), loss[held].sum(), held.sum()]
                p[np.arange(len(y)), y] -= 1
                g += p[~held].T @ x[~held]
        seen = sums[1] + sums[3] > 0
        out = [*g.tolist(), sums.tolist()] if seen else []
        yield _rows_of(out, TaskContext.get().partitionId())

    found = _summed(rows.select("v", "c", "held").mapInArrow(part, "c int, task int, x array<double>"))
    sums = found[-1].x
    return np.array([r.x for r in found[:-1]]) / sums[1], sums[0] / sums[1], sums[2] / sums[3] if sums[3] else float("nan")


def fit(train: DataFrame, held: DataFrame, epochs: int = 50, patience: int = 5, l2: float = 1e-3) -> dict:
    """Weights of the epoch with the least loss on ``held``, and the history that shows it.

    train, held: (v, label). Rows with a null label, or a vector that is null or has null or non-finite components, take no
    part, nor do held rows of classes that ``train`` lacks. An epoch is one step; epoch 0 is before the first. It ends once the loss
    on held rows has not improved for ``patience`` epochs. Without held rows the last epoch counts. Returns labels (in
    order), weights (classes x dimensions + 1, the intercept last), history (epoch, train_loss, loss) and stop (best_epoch,
    best_loss, stopped_epoch). Two passes at least; each reads a table written once. Empty ``train``: ValueError.
    """
    part = lambda df, flag: df.filter(sound("v")).filter("label is not null").select("v", "label", F.lit(flag).alias("held"))
    both = part(train, False).unionByName(part(held, True))
    labels = [r.label for r in part(train, False).select("label").distinct().orderBy("label").collect()]  # the classes
    if not labels:
        raise ValueError("no rows to learn from")
    spark, d = train.sparkSession, part(train, False).select(F.size("v").alias("d")).first().d
    if 8 * (d + 1) * max(len(labels), d + 1) > MOST_BYTES:
        raise ValueError(f"{len(labels)} classes x {d} dimensions exceed {MOST_BYTES} bytes of weights")
    index = spark.createDataFrame(list(enumerate(labels)), "c int, label string")
    rows = settle(both.join(F.broadcast(index), "label").select("v", "c", "held"), "linear-rows")
    second, _ = _moments(rows, d)
    ridge = np.full(d + 1, l2)
    ridge[-1] = 0  # the intercept is free
    step = np.linalg.pinv(second / 2 + np.diag(ridge))
    w, kept, history, best = np.zeros((len(labels), d + 1)), None, [], (float("inf"), -1)
    for epoch in range(epochs + 1):
        g, own, other = _pass(rows, w)
        history.append((epoch, float(own), float(other)))
        if np.isnan(other) or other < best[0]:
            best, kept = (float(other), epoch), w
        if epoch - best[1] >= patience:
            break
        w = w - (g + w * ridge) @ step
    table = spark.createDataFrame([("head", *h) for h in history], "run string, epoch int, train_loss double, loss double")
    measured = table if not np.isnan(history[0][2]) else table.withColumn("loss", -F.col("epoch").cast("double"))
    stop = early_stop(measured, ["run"], patience).drop("run")
    return {"labels": labels, "weights": kept, "history": table.drop("run"), "stop": stop}


def predict(rows: DataFrame, model: dict) -> DataFrame:
    """rows (id, v, ...) with pred, the class of the largest probability (ties: the first in order), and confidence, that probability.
    Both are null where the vector is null or has null or non-finite components. Ids are to be distinct."""
    w, labels = model["weights"], model["labels"]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                t = pa.Table.from_batches([b.slice(at, _ROWS)])
                p = _softmax(_with_one(t), w)
                top = p.argmax(1)
                yield pa.RecordBatch.from_pydict({"__id": t.column("__id").combine_chunks(), "pred": pa.array([labels[i] for i in top], pa.string()), "confidence": pa.array(p.max(1))})

    said = rows.filter(sound("v")).select(F.col("id").alias("__id"), "v").mapInArrow(part, f"__id {rows.schema['id'].dataType.simpleString()}, pred string, confidence double")
    return rows.drop("pred", "confidence").join(said, F.col("id") == F.col("__id"), "left").drop("__id")
