"""Classification metrics of many runs at once, from contingency counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import coarse
from ..schema import TEMPLATED


def contingency(rows: DataFrame, keys: list[str], truth: str = "truth", pred: str = "pred", weight: Column | None = None) -> DataFrame:
    """(keys, truth, pred, n)."""
    return rows.groupBy(*keys, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))


def marginals(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, class, t, p, d): rows of a class, rows given to it, rows of it given to it; classes of both columns."""
    side = F.explode(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("d")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"), F.lit(0).cast("long").alias("d"))))
    return counts.select(*keys, side.alias("s")).groupBy(*keys, F.col("s.class").alias("class")).agg(*(F.sum(f"s.{c}").alias(c) for c in "tpd"))


def scores_of(classes: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """accuracy, support-weighted precision, recall and f1, mcc, cohen_kappa and degenerate (kappa is 0/0; then 0) by key."""
    d, t, p = F.col("d"), F.col("t"), F.col("p")
    sums = classes.groupBy(*keys).agg(
        F.sum("t").alias("n"), F.sum("d").alias("c"), F.sum(t * p).cast("double").alias("tp"), F.sum(t * t).cast("double").alias("tt"), F.sum(p * p).cast("double").alias("pp"),
        F.sum(F.when(p > 0, t * d / p).otherwise(0.0)).alias("wp"), F.sum(F.when(t + p > 0, t * 2 * d / (t + p)).otherwise(0.0)).alias("wf"),
    )
    n, c = F.col("n").cast("double"), F.col("c").cast("double")
    root = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))
    chance = F.col("tp") / (n * n)
    r = lambda x: F.round(x, digits)
    return sums.select(
        *keys, "n", r(c / n).alias("accuracy"), r(F.col("wp") / n).alias("precision"), r(c / n).alias("recall"), r(F.col("wf") / n).alias("f1"),
        r(F.when(root > 0, (n * c - F.col("tp")) / root).otherwise(0.0)).alias("mcc"),
        r(F.when(chance < 1, (c / n - chance) / (1 - chance)).otherwise(0.0)).alias("cohen_kappa"), (chance >= 1).alias("degenerate"),
    )


def scores(rows: DataFrame, keys: list[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    return scores_of(marginals(contingency(rows, keys, truth, pred), keys), keys)


def coverage(rows: DataFrame, keys: list[str], reject: str, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """covered and rejected counts, coverage and accuracy on what is covered (0 if nothing is)."""
    kept = F.col(pred) != reject
    right = F.col(pred) == F.col(truth)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(kept).alias("covered_count"), F.count_if(kept & right).alias("right"))
    return sums.select(*keys, "covered_count", (F.col("n") - F.col("covered_count")).alias("rejected_count"), F.round(F.col("covered_count") / F.col("n"), 6).alias("coverage"), F.round(F.when(F.col("covered_count") > 0, F.col("right") / F.col("covered_count")).otherwise(0.0), 6).alias("covered_accuracy"))


def open_set_views(rows: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Each row as it counts in each view: fine, coarse, binary, and fine among truly or predicted templated rows."""
    t, p = coarse(F.col(truth)), coarse(F.col(pred))
    view = lambda name, a, b: F.struct(F.lit(name).alias("view"), a.alias("truth"), b.alias("pred"))
    binary = lambda c: F.when(c == TEMPLATED, "templated").otherwise("rest")
    fine = (F.col(truth), F.col(pred))
    some = F.array(view("fine", *fine), view("coarse", t, p), view("binary", binary(t), binary(p)), F.when(p == TEMPLATED, view("fine_pred_templated", *fine)), F.when(t == TEMPLATED, view("fine_true_templated", *fine)))
    others = [c for c in rows.columns if c not in (truth, pred)]
    return rows.select(*others, F.explode(F.filter(some, lambda x: x.isNotNull())).alias("v")).select(*others, "v.*")


def join_labels(preds: DataFrame, labels: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(joined rows, counts by key of predictions without a label and labels without a prediction)."""
    joined = preds.join(labels, "sample_id")
    n = labels.count()
    found = preds.join(labels.select("sample_id", F.lit(1).alias("__l")), "sample_id", "left").groupBy(*keys).agg(F.count_if(F.col("__l").isNull()).alias("unlabelled_predictions"), F.count("__l").alias("matched"))
    return joined, found.withColumn("unpredicted_labels", F.lit(n) - F.col("matched"))


def binary_scores(rows: DataFrame, keys: list[str], positive: str, truth: str = "truth", pred: str = "pred") -> DataFrame:
    t, p = F.col(truth) == positive, F.col(pred) == positive
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t == p).alias("right"))
    safe = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select(*keys, "n", "tp", "fp", "fn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), safe(F.col("right"), F.col("n")).alias("accuracy"))


def seed_summary(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, mean, std, n_seeds): over runs, std with n - 1."""
    long = runs.unpivot(keys + ["seed"], metrics, "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"), F.count_distinct("seed").alias("n_seeds"))


def timing(rows: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """Counts and times of each key's rows; per_hour is null where no time was taken."""
    s = F.col(seconds)
    return rows.groupBy(*keys).agg(F.count(s).alias("n"), F.round(F.avg(s), 3).alias("mean_s"), F.round(F.sum(s), 3).alias("total_s"), F.round(F.sum(s) / 60, 3).alias("total_min"), F.round(F.try_divide(F.count(s) * 3600, F.sum(s)), 3).alias("per_hour"))
