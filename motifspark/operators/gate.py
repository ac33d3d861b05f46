"""Rejection: thresholds from scores, two-stage gates, confidence calibration, and early stopping over a history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NON_MEME, REJECTED_BY_STAGE1, TEMPLATE_FREE


def roc(rows: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """(threshold, tpr, fpr, gmean, selected) at every distinct score, highest first; selected: the first largest gmean.
    With rows of one class only, the other's rate and gmean are null and nothing is selected.

    Rows are summed per score before they are ordered. Running sums are taken in two steps, inside ranges of
    scores and over the ranges' totals, so no task orders all distinct scores.
    """
    by = rows.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    by = by.withColumn("__r", F.floor(F.col("threshold") * 256))
    inner = Window.partitionBy("__r").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranges = by.groupBy("__r").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    above = Window.orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    base = ranges.select("__r", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("bn"), F.sum("rp").over(whole).alias("tp"), F.sum("rn").over(whole).alias("tn"))
    out = by.withColumn("cp", F.sum("p").over(inner)).withColumn("cn", F.sum("n").over(inner)).join(base, "__r")
    tpr, fpr = F.try_divide(F.col("cp") + F.col("bp"), "tp"), F.try_divide(F.col("cn") + F.col("bn"), "tn")
    out = out.select("threshold", F.round(tpr, 6).alias("tpr"), F.round(fpr, 6).alias("fpr"), F.round(F.sqrt(tpr * (1 - fpr)), 6).alias("gmean"))
    best = out.filter("gmean is not null").agg(F.max(F.struct("gmean", "threshold")).alias("s")).select(F.col("s.threshold").alias("__best"))
    return out.join(F.broadcast(best)).withColumn("selected", F.coalesce(F.col("threshold") == F.col("__best"), F.lit(False))).drop("__best")  # one row


def roc_points(rows: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """``roc`` from an infinite threshold that nothing reaches, without points on a line between their neighbours.

    A point stays if the rows that the next score adds differ in either kind from its own; the first and the last stay. The
    next score is met inside a range of scores, or is the next range's first, so no task orders all scores. Dropped points
    never hold the largest gmean alone: of collinear points an end is as good.
    """
    by = rows.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    by = by.withColumn("__r", F.floor(F.col("threshold") * 256))
    down = Window.partitionBy("__r").orderBy(F.col("threshold").desc())
    firsts = by.groupBy("__r").agg(F.max_by(F.struct("p", "n"), "threshold").alias("first")).withColumn("across", F.lead("first").over(Window.orderBy(F.col("__r").desc()))).select("__r", "across")
    met = by.withColumn("next", F.lead(F.struct("p", "n")).over(down)).join(firsts, "__r").withColumn("next", F.coalesce("next", "across"))
    kept = met.filter(F.col("next").isNull() | (F.col("next.p") != F.col("p")) | (F.col("next.n") != F.col("n"))).select("threshold")
    points = roc(rows.filter(F.col(score).isNotNull()).withColumn(score, F.col(score).cast("double")), score, positive)
    start = rows.agg(F.count_if(F.col(score).isNotNull() & F.col(positive)).alias("tp"), F.count_if(F.col(score).isNotNull() & ~F.col(positive)).alias("tn")).filter("tp + tn > 0")
    first = start.select(F.lit(float("inf")).alias("threshold"), F.when(F.col("tp") > 0, 0.0).alias("tpr"), F.when(F.col("tn") > 0, 0.0).alias("fpr"), F.when((F.col("tp") > 0) & (F.col("tn") > 0), 0.0).alias("gmean"), F.lit(False).alias("selected"))
    drawn = points.drop("selected").join(kept, "threshold", "left_semi")
    best = drawn.filter("gmean is not null").agg(F.max(F.struct("gmean", "threshold")).alias("s")).select(F.col("s.threshold").alias("__best"))
    return first.unionByName(drawn.join(F.broadcast(best)).withColumn("selected", F.coalesce(F.col("threshold") == F.col("__best"), F.lit(False))).drop("__best"))  # one row


def two_stage(rows: DataFrame, threshold: float, reject: str = REJECTED_BY_STAGE1) -> DataFrame:
    """pred: the second stage's label where p_meme (missing: 1) reaches the threshold, else the reject token."""
    passed = F.coalesce("p_meme", F.lit(1.0)) >= threshold
    return rows.withColumn("is_rejected", ~passed).withColumn("pred", F.when(passed, F.col("stage2_label")).otherwise(reject))


def calibrate(rows: DataFrame, percent: float, fixed: float | None = None) -> DataFrame:
    """(threshold, min, p05, median, max) of confidence over rows that are not truly Non-Meme; a fixed value wins."""
    own = rows.filter(F.col("truth") != NON_MEME)
    p = lambda q: F.round(F.percentile("confidence", q), 6)
    cut = p(percent / 100) if fixed is None else F.lit(float(fixed))
    return own.agg(cut.alias("threshold"), F.round(F.min("confidence"), 6).alias("min"), p(0.05).alias("p05"), p(0.5).alias("median"), F.round(F.max("confidence"), 6).alias("max"))


def apply_confidence(rows: DataFrame, threshold: float, to: str = TEMPLATE_FREE) -> DataFrame:
    """demoted rows get ``to``; Non-Meme is never demoted."""
    demoted = (F.col("confidence") < threshold) & (F.col("pred") != NON_MEME)
    return rows.withColumn("demoted", demoted).withColumn("pred", F.when(demoted, to).otherwise(F.col("pred")))


def early_stop(history: DataFrame, keys: list[str], patience: int) -> DataFrame:
    """(keys, best_epoch, best_loss, stopped_epoch): the first strict minimum before the loss has not improved for ``patience`` epochs."""
    w = Window.partitionBy(*keys).orderBy("epoch")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = history.withColumn("better", F.coalesce(F.col("loss") < F.min("loss").over(before), F.lit(True)))
    last = marked.withColumn("best_at", F.max(F.when(F.col("better"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stops = last.withColumn("wait", F.col("epoch") - F.col("best_at"))
    end = stops.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("wait") >= patience, F.col("epoch"))), F.max("epoch")).alias("stopped_epoch"))
    kept = stops.join(end, keys).filter("better and epoch <= stopped_epoch")
    return kept.groupBy(*keys).agg(F.max(F.struct("epoch", "loss")).alias("s"), F.first("stopped_epoch").alias("stopped_epoch")).select(*keys, F.col("s.epoch").alias("best_epoch"), F.col("s.loss").alias("best_loss"), "stopped_epoch")
