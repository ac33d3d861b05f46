"""Filters, splits, sampling and set operations on labelled rows.

Every rule that depended on row order takes an order key here. Seeded choices order rows by a hash of
seed and key, so they don't depend on how Spark deals rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import TRAIN_SOURCE


def seeded(seed: int, *keys: str) -> Column:
    """A hash order that SQL can restate: the MD5 text of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def exclude_templates(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.filter(~F.col("template").isin(names)) if names else rows


def drop_small_classes(rows: DataFrame, least: int = 7) -> DataFrame:
    big = rows.groupBy("template").count().filter(F.col("count") >= least).select("template")
    return rows.join(big, "template", "left_semi")


def class_summary(rows: DataFrame, least: int = 7) -> DataFrame:
    """Templates and rows before and after ``drop_small_classes``."""
    kept = F.col("n") >= least
    return rows.groupBy("template").agg(F.count("*").alias("n")).agg(F.count("*").alias("templates_before"), F.sum("n").alias("rows_before"), F.count_if(kept).alias("templates_after"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("rows_after"))


def removed_classes(rows: DataFrame, least: int = 7, top: int = 20) -> DataFrame:
    """(template, n): the largest of the classes that ``drop_small_classes`` takes away, ties in order of name."""
    return rows.groupBy("template").agg(F.count("*").alias("n")).filter(F.col("n") < least).orderBy(F.col("n").desc(), "template").limit(top)


def excluded_count(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row (template, n) for each name: how many rows ``exclude_templates`` takes away, 0 where there is none."""
    asked = rows.sparkSession.createDataFrame([(n,) for n in sorted(set(names))], "template string")
    found = rows.filter(F.col("template").isin(names)).groupBy("template").agg(F.count("*").alias("n"))
    return asked.join(found, "template", "left").select("template", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def missing_templates(wanted: list[str], found: DataFrame) -> DataFrame:
    """(template): wanted names, blanks dropped, of which ``found`` (template) has no row."""
    asked = found.sparkSession.createDataFrame([(n.strip(),) for n in dict.fromkeys(wanted) if n and n.strip()], "template string").distinct()
    return asked.join(found.select("template"), "template", "left_anti")


def missing_paths(rows: DataFrame, path: str, listing: DataFrame) -> DataFrame:
    """One row (rows, missing): how many rows there are, and of how many the path is null or not in ``listing`` (path)."""
    there = listing.select(F.col("path").alias("__path"), F.lit(True).alias("__there")).distinct()
    met = rows.select(F.col(path).alias("__path")).join(there, "__path", "left")
    return met.agg(F.count("*").alias("rows"), F.count_if(F.col("__there").isNull()).alias("missing"))


def until(rows: DataFrame, order: str, done: Column, most: int) -> DataFrame:
    """The rows up to the one that is the ``most``-th done in ``order`` (unique), all if fewer are; none if most is 0."""
    last = rows.filter(done).select(F.col(order).alias("__o")).orderBy("__o").limit(most)
    bound = last.agg(F.max("__o").alias("__last"), F.count("*").alias("__n"))
    met = rows.crossJoin(F.broadcast(bound))  # a single row
    return met.filter((F.col("__n") < most) | (F.col(order) <= F.col("__last"))).drop("__last", "__n")


def first_templates(rows: DataFrame, n: int) -> DataFrame:
    names = rows.select("template").distinct().orderBy("template").limit(n)
    return rows.join(names, "template", "left_semi")


def first_per_template(rows: DataFrame, n: int, order: str) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy("template").orderBy(order))).filter(F.col("__k") <= n).drop("__k")


def budgeted(rows: DataFrame, cap: int, order: str) -> DataFrame:
    """At most cap rows: max(1, cap // templates) of each template, then the first cap in order."""
    n = max(1, cap // max(1, rows.select("template").distinct().count()))
    return first_per_template(rows, n, order).orderBy("template", order).limit(cap)


def sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement, if there are more."""
    return rows.orderBy(seeded(seed, key), key).limit(n) if n > 0 else rows


def exclude_content(rows: DataFrame, held_out: DataFrame, content: str) -> DataFrame:
    """Rows whose bytes are no held-out row's: sizes are met first, so hashes are made for rows of a held-out size only."""
    sizes = held_out.select(F.octet_length(content).alias("__size")).distinct()
    hashes = held_out.select(F.sha2(F.col(content), 256).alias("__hash")).distinct()
    sized = rows.withColumn("__size", F.octet_length(content))
    suspect = sized.join(sizes, "__size", "left_semi").withColumn("__hash", F.sha2(F.col(content), 256)).join(hashes, "__hash", "left_anti").drop("__hash")
    return sized.join(sizes, "__size", "left_anti").unionByName(suspect).drop("__size")


def stratified_split(rows: DataFrame, fraction: float, seed: int, key: str, round_up: bool = False) -> DataFrame:
    """``rows`` with part: train for floor (or ceil) of n * fraction rows overall, else test.

    Every template gets the floor of its share, and the largest remainders (ties: by name) one more, so the
    total is exact. One window orders the classes; another ranks rows inside each.
    """
    sizes = rows.groupBy("template").agg(F.count("*").alias("n")).withColumn("share", F.col("n") * F.lit(fraction))
    sizes = sizes.withColumn("base", F.floor("share")).withColumn("rest", F.round(F.col("share") - F.col("base"), 9))
    whole = F.sum("n").over(Window.partitionBy()) * F.lit(fraction)
    total = F.ceil(F.round(whole, 6)) if round_up else F.floor(F.round(whole, 6))
    more = total - F.sum("base").over(Window.partitionBy())
    quota = sizes.withColumn("more", more).withColumn("r", F.row_number().over(Window.orderBy(F.col("rest").desc(), "template")))
    quota = quota.select("template", (F.col("base") + (F.col("r") <= F.col("more")).cast("int")).alias("quota"))
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy("template").orderBy(seeded(seed, key), key)))
    return ranked.join(quota, "template").withColumn("part", F.when(F.col("__k") <= F.col("quota"), "train").otherwise("test")).drop("__k", "quota")


def add_class(train: DataFrame, test: DataFrame | None, extra: DataFrame, fraction: float, seed: int, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of one more class, split like the templates and put in; without a test side all go to train."""
    if test is None:
        return train.unionByName(extra, allowMissingColumns=True), None
    cut = stratified_split(extra, fraction, seed, key)
    part = lambda p: cut.filter(F.col("part") == p).drop("part")
    return train.unionByName(part("train"), allowMissingColumns=True), test.unionByName(part("test"), allowMissingColumns=True)


def duplicate_as_unlabelled(train: DataFrame, n: int, seed: int, key: str, label: str) -> DataFrame:
    return sample(train, n, seed, key).withColumn("template", F.lit(label)).withColumn("source", F.lit("imgflip_unlabeled"))


def common_ids(rows: DataFrame, id: str, by: str) -> DataFrame:
    """Ids that every value of ``by`` has."""
    n = rows.select(by).distinct().count()
    return rows.groupBy(id).agg(F.count_distinct(by).alias("n")).filter(F.col("n") == n).select(id)


def pending(rows: DataFrame, done: DataFrame, id: str) -> DataFrame:
    return rows.join(done.select(id), id, "left_anti")


def label_map_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in which two label maps (label, label_idx) differ."""
    x, y = a.withColumnRenamed("label_idx", "idx_a"), b.withColumnRenamed("label_idx", "idx_b")
    return x.join(y, "label", "full_outer").filter(~F.col("idx_a").eqNullSafe(F.col("idx_b")))


def replace_prefix_all(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def replace_prefix_first(c: Column, old: str, new: str) -> Column:
    at = F.locate(old, c)
    return F.when(at == 0, c).otherwise(F.concat(F.substring(c, F.lit(1), at - 1), F.lit(new), F.substring(c, at + len(old), F.length(c))))


def discovery(train: DataFrame, extra: DataFrame | None = None, unlabelled: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """All rows that clusters are made from: training rows, those of one more class counted as such, and rows without a label."""
    out = train
    for more in (None if extra is None else retagged(extra), unlabelled, corpus):
        if more is not None:
            out = out.unionByName(more, allowMissingColumns=True)
    return out


def retagged(rows: DataFrame, source: str = TRAIN_SOURCE) -> DataFrame:
    """rows under another source, so that they vote as that source's do."""
    return rows.withColumn("source", F.lit(source))


def aligned(rows: DataFrame, kept: DataFrame, key: str, order: str) -> DataFrame:
    """The rows whose key is among ``kept`` (key), one for each; of rows with one key the last in ``order`` counts."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("__s")).select(key, "__s.*")
    return last.join(kept.select(key).distinct(), key, "left_semi")
