"""Density and centroid clustering on tables, and naming clusters by their labelled members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, hamming, unit
from ..schema import TRAIN_SOURCE, UNKNOWN_CLUSTER
from ..tables import settle
from .densejoin import nearest_centroid
from .graph import connected_components, numbered
from .hashjoin import MOST_BANDED, near_hashes
from .widescan import wide_dbscan


def dbscan(points: DataFrame, edges: DataFrame, min_samples: int = 5) -> DataFrame:
    """(id, cluster_id, core) of ``points`` (id, perhaps n): clusters of core points linked by ``edges`` (id, other; both ways, self included or not).

    n: rows at that very point, 1 if there is no such column. A point is core with min_samples neighbours, all rows at
    the point included. A border point joins the cluster with the smallest number among its core neighbours; clusters
    are numbered by their smallest core id; noise is -1.
    """
    pairs = settle(edges.filter("id <> other").select("id", "other").distinct(), "dbscan-pairs")
    own = points.select("id", (F.col("n") if "n" in points.columns else F.lit(1)).cast("long").alias("n"))
    degree = pairs.join(own.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.sum("n").alias("degree"))
    core = settle(own.join(degree, "id", "left").filter(F.coalesce("degree", F.lit(0)) + F.col("n") >= min_samples).select("id"), "dbscan-core")
    linked = pairs.join(core, "id", "left_semi").join(core.withColumnRenamed("id", "other"), "other", "left_semi")
    lone = core.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    parts = connected_components(linked.select(F.col("id").alias("src"), F.col("other").alias("dst")).unionByName(lone), "dbscan")
    number = numbered(parts, "component", "cluster_id", "dbscan-numbers")
    cores = settle(parts.join(number, "component").select(F.col("node").alias("id"), "cluster_id"), "dbscan-cores")
    border = pairs.join(core, "id", "left_anti").join(cores.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("cluster_id").alias("cluster_id"))
    named = cores.withColumn("core", F.lit(True)).unionByName(border.withColumn("core", F.lit(False)))
    return points.select("id").join(named, "id", "left").select("id", F.coalesce("cluster_id", F.lit(-1).cast("long")).alias("cluster_id"), F.coalesce("core", F.lit(False)).alias("core"))


def hash_dbscan(rows: DataFrame, radius: int, min_samples: int = 5) -> DataFrame:
    """(id, cluster_id, core) of ``rows`` (id, h): ``dbscan`` over hashes within ``radius`` bits of each other.

    Distinct hashes are clustered, each with the number of its rows, and rows join them at the end: a hash that n rows
    share costs one point, not n * n edges. Rows whose hash is null are noise. Past the radius of bands, pairs are not listed.
    """
    if radius > MOST_BANDED:
        return wide_dbscan(rows, radius, min_samples)
    points = settle(rows.filter("h is not null").groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("n")), "dbscan-hashes")
    near = near_hashes(points, points, radius).filter("h <> g")
    edges = near.join(points.select("h", "id"), "h").join(points.select(F.col("h").alias("g"), F.col("id").alias("other")), "g")
    found = points.select("id", "h").join(dbscan(points.select("id", "n"), edges, min_samples), "id").select("h", "cluster_id", "core")
    return rows.select("id", "h").join(found, "h", "left").select("id", F.coalesce("cluster_id", F.lit(-1).cast("long")).alias("cluster_id"), F.coalesce("core", F.lit(False)).alias("core"))


def centroids(rows: DataFrame) -> DataFrame:
    """(cluster_id, v): unit means of the members' vectors (cluster_id, v); noise is left out."""
    mean = rows.filter("cluster_id >= 0").select("cluster_id", F.posexplode("v").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg("x").alias("x"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])  # one number for each dimension
    return mean.groupBy("cluster_id").agg(v.alias("v")).select("cluster_id", unit(F.col("v")).alias("v"))


def refine(rows: DataFrame, steps: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows with new cluster_id, centroids): every row, noise too, goes to its nearest centroid; centroids again; steps times."""
    centres = centroids(rows)
    for k in range(steps):
        found = nearest_centroid(rows.select("id", "v"), centres)
        rows = settle(rows.drop("cluster_id").join(found.select("id", "cluster_id"), "id"), f"refine{k}")
        centres = centroids(rows)
    return rows, centres


def medoids(rows: DataFrame) -> DataFrame:
    """(cluster_id, id, h): the member (id, h, cluster_id) nearest to the cluster's bit majority (half counts as one), ties to the smaller id."""
    bits = rows.filter("cluster_id >= 0")
    share = [F.avg(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(1)).cast("double")).alias(f"b{i}") for i in range(64)]
    majority = bits.groupBy("cluster_id").agg(*share)
    whole = F.lit(0).cast("long")
    for i in range(64):
        whole = whole.bitwiseOR(F.when(F.col(f"b{i}") >= 0.5, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    majority = majority.select("cluster_id", whole.alias("major"))
    best = bits.join(majority, "cluster_id").groupBy("cluster_id").agg(F.min(F.struct(hamming(F.col("h"), F.col("major")).alias("d"), "id", "h")).alias("s"))
    return best.select("cluster_id", "s.id", "s.h")


def name_clusters(rows: DataFrame) -> DataFrame:
    """(cluster_id, template): the most frequent template among labelled members, ties to the first in order; noise and unlabelled clusters have none."""
    return rows.filter((F.col("source") == TRAIN_SOURCE) & (F.col("cluster_id") >= 0)).groupBy("cluster_id").agg(F.mode("template", True).alias("template"))


def restrict_to_named(representatives: DataFrame, names: DataFrame) -> DataFrame:
    """The representatives (cluster_id, ...) of named clusters; raises if no cluster has a name."""
    kept = representatives.join(names.select("cluster_id"), "cluster_id", "left_semi")
    if kept.isEmpty():
        raise ValueError("no cluster has a labelled member")
    return kept


def closed_predictions(assigned: DataFrame, names: DataFrame) -> DataFrame:
    """pred_template of rows assigned among named clusters."""
    return assigned.join(names.withColumnRenamed("template", "pred_template"), "cluster_id", "left").withColumn("pred_template", F.coalesce("pred_template", F.lit(UNKNOWN_CLUSTER)))


def open_predictions(assigned: DataFrame, names: DataFrame, reject: str) -> DataFrame:
    """pred_label of rows assigned among all clusters; an unnamed one rejects."""
    return assigned.join(names.withColumnRenamed("template", "pred_label"), "cluster_id", "left").withColumn("pred_label", F.coalesce("pred_label", F.lit(reject)))


def typicality(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """rows with score: cosine to the own centroid; noise is minus infinity."""
    met = rows.join(centres.withColumnRenamed("v", "__c"), "cluster_id", "left")
    return met.withColumn("score", F.when(F.col("__c").isNull(), F.lit(float("-inf"))).otherwise(dot(F.col("v"), F.col("__c")))).drop("__c")


def cluster_examples(rows: DataFrame, names: DataFrame, top: int = 6) -> DataFrame:
    """(cluster_id, template, n_members, n_labeled_members, example_paths): the most typical members' paths, joined by |."""
    members = rows.filter("cluster_id >= 0")
    counts = members.groupBy("cluster_id").agg(F.count("*").alias("n_members"), F.count_if(F.col("source") == TRAIN_SOURCE).alias("n_labeled_members"))
    ranked = members.withColumn("k", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.round("score", 9).desc(), "image_path"))).filter(F.col("k") <= top)
    paths = ranked.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "image_path"))), lambda s: s["image_path"]), "|").alias("example_paths"))
    return counts.join(paths, "cluster_id").join(names, "cluster_id", "left").select("cluster_id", F.coalesce("template", F.lit("")).alias("template"), "n_members", "n_labeled_members", "example_paths")


def run_counters(rows: DataFrame, names: DataFrame) -> DataFrame:
    """clusters_discovered, clusters_named, noise_points."""
    flags = rows.join(names.select("cluster_id", F.lit(1).alias("named")), "cluster_id", "left")
    c = F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))
    return flags.agg(F.count_distinct(c).alias("clusters_discovered"), F.count_distinct(F.when(F.col("named") == 1, c)).alias("clusters_named"), F.count_if(F.col("cluster_id") < 0).alias("noise_points"))


def prediction_counters(predictions: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """unknown_predictions of (pred_template), and neighbour_edges (id, other; both ways) without those to the row itself, 0 if not given.
    Edges may come counted, as one row (neighbour_edges)."""
    unknown = predictions.agg(F.count_if(F.col("pred_template") == UNKNOWN_CLUSTER).alias("unknown_predictions"))
    if edges is None:
        return unknown.withColumn("neighbour_edges", F.lit(0).cast("long"))
    if "neighbour_edges" in edges.columns:
        return unknown.crossJoin(edges.select("neighbour_edges"))
    return unknown.crossJoin(edges.agg(F.count_if(F.col("id") != F.col("other")).alias("neighbour_edges")))  # a single row each


def kmeans(rows: DataFrame, k: int, seed: int = 40):
    """MLlib k-means (parallel initialisation) of (id, v): (id, cluster_id) and the model. The block solver sends sums of
    centres to the driver; the row solver sends the distances of all pairs of centres in every step."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, initMode="k-means||", featuresCol="features", solver="block").fit(rows.select(array_to_vector("v").alias("features")))
    out = model.transform(rows.withColumn("features", array_to_vector("v"))).select("id", F.col("prediction").cast("long").alias("cluster_id"))
    return out, model


def pseudo_label_k(n: int) -> int:
    return max(2, min(1024, max(32, n // 100), n))
