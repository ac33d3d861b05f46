"""Fitted models over vectors: scaling, centred PCA, weighted logistic regression, sparse codes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def position_moments(rows: DataFrame) -> DataFrame:
    """One row (mean, std): arrays of each position's mean and population deviation over vectors ``v``; as long as a vector."""
    by_position = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    sorted_ = F.array_sort(F.collect_list(F.struct("i", "m", "s")))  # one entry for each dimension
    return by_position.agg(sorted_.alias("p")).select(F.transform("p", lambda p: p["m"]).alias("mean"), F.transform("p", lambda p: p["s"]).alias("std"))


def standardise(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """``rows`` with v scaled position by position; a position that never varies is centred only."""
    met = rows.crossJoin(F.broadcast(moments))  # a single row
    scaled = F.zip_with(F.zip_with("v", "mean", lambda x, m: x - m), "std", lambda x, s: x / F.when(s > 1e-12, s).otherwise(1.0))
    return met.withColumn("v", scaled).drop("mean", "std")


def reducer(fit_on: DataFrame, k: int) -> Callable[[DataFrame], DataFrame]:
    """What projects v on the k leading components of ``fit_on`` (all of them, where a vector is shorter), centred on its mean."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    mean = position_moments(fit_on).select("mean")

    def centred(part: DataFrame) -> DataFrame:
        return part.crossJoin(F.broadcast(mean)).withColumn("__x", array_to_vector(F.zip_with("v", "mean", lambda x, m: x - m))).drop("mean")  # a single row

    first = mean.select(F.size("mean").alias("n")).first()
    model = PCA(k=max(1, min(k, first["n"])), inputCol="__x", outputCol="__y").fit(centred(fit_on.select("v")))
    return lambda rows: model.transform(centred(rows)).withColumn("v", vector_to_array("__y")).drop("__x", "__y")


def pca(rows: DataFrame, fit_on: DataFrame, k: int) -> DataFrame:
    """``rows`` with v projected on the k leading components of ``fit_on``; both are centred on its mean first."""
    return reducer(fit_on, k)(rows)


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with weight: rows / (classes * rows of the class)."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("__n"))
    whole = sizes.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    by_class = sizes.crossJoin(F.broadcast(whole)).select(F.col(label).alias("__label"), (F.col("__all") / (F.col("__k") * F.col("__n"))).alias("weight"))
    return rows.join(by_class, F.col(label) == F.col("__label")).drop("__label")


def logistic(train: DataFrame, rows: DataFrame, c: float = 1.0, iterations: int = 1000) -> DataFrame:
    """``rows`` (v, ...) with pred and confidence by a multinomial model of ``train`` (v, label) with balanced class weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StringIndexer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    weighted = balanced_weights(train.select("v", "label"), "label").withColumn("features", array_to_vector("v"))
    index = StringIndexer(inputCol="label", outputCol="__y", stringOrderType="alphabetAsc").fit(weighted)
    model = LogisticRegression(family="multinomial", labelCol="__y", weightCol="weight", maxIter=iterations, regParam=1 / (c * max(1, weighted.count())), standardization=False, predictionCol="__p", probabilityCol="__q", rawPredictionCol="__r").fit(index.transform(weighted))
    out = model.transform(rows.withColumn("features", array_to_vector("v")))
    named = IndexToString(inputCol="__p", outputCol="pred", labels=index.labels).transform(out)
    return named.withColumn("confidence", F.array_max(vector_to_array("__q"))).drop("features", "__p", "__q", "__r")


def lasso(atoms: np.ndarray, targets: np.ndarray, alpha: float, sweeps: int, tolerance: float = 1e-6) -> np.ndarray:
    """Rows of coefficients that minimise |y - x A|^2 / (2 * dimensions) + alpha * |x|_1 for each target y; all targets move together."""
    norms = (atoms * atoms).sum(1)
    x, rest = np.zeros((len(targets), len(atoms))), targets.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in np.flatnonzero(norms > 0):
            pull = rest @ atoms[j] + x[:, j] * norms[j]
            new = np.sign(pull) * np.maximum(np.abs(pull) - alpha * atoms.shape[1], 0) / norms[j]
            step = new - x[:, j]
            far = np.abs(step).max()
            if far:
                rest -= step[:, None] * atoms[j]
                x[:, j], moved = new, max(moved, far)
        if moved < tolerance:
            break
    return x
