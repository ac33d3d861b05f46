"""Radius-neighbour votes, whole parameter grids at once, and choosing a combination."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import OUTLIER
from .densejoin import cosine_cells, cosine_radius_join
from .hashjoin import band_masks, radius_join


def votes(edges: DataFrame, keys: list[str], weights: str = "uniform", zero_rule: bool = True, least_distance: float = 1e-6) -> DataFrame:
    """(keys, label) that wins among neighbours (keys, label, dist, perhaps copies: how many rows vote as one); ties to the
    first label in order.

    distance: weight 1 / d; with the zero rule a query's zero-distance neighbours alone count, else d is at least
    ``least_distance``.
    """
    n = edges
    if weights == "uniform":
        w: Column = F.lit(1.0)
    elif zero_rule:
        n = edges.withColumn("__zero", F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy(*keys)))
        w = F.when(F.col("__zero") == 1, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    else:
        w = 1.0 / F.greatest(F.col("dist").cast("double"), F.lit(least_distance))
    by = n.groupBy(*keys, "label").agg(F.round(F.sum(w * F.col("copies") if "copies" in n.columns else w), 9).alias("w"))
    order = Window.partitionBy(*keys).orderBy(F.col("w").desc(), "label")
    return by.withColumn("__k", F.row_number().over(order)).filter("__k = 1").select(*keys, "label")


def cells(edges: DataFrame, radii: list) -> DataFrame:
    """(id, label, bin, n, zero, inverse) of edges (id, label, dist, perhaps copies) up to the largest radius: for the edges whose
    smallest radius of the ascending ``radii`` has the number bin, their count, that of distance 0 and the sum of 1 / dist of the
    others. Votes of every radius follow from these, so a task passes on labels and radii of an id, not its edges. Edges that come
    as cells stay as they are."""
    if "bin" in edges.columns:
        return edges
    one = F.col("copies") if "copies" in edges.columns else F.lit(1)
    near = edges.filter(F.col("dist") <= max(radii)).withColumn("bin", sum((F.col("dist") > F.lit(float(r))).cast("int") for r in sorted(radii)))
    zero = F.col("dist") == 0
    return near.groupBy("id", "label", "bin").agg(F.sum(one).alias("n"), F.sum(F.when(zero, one).otherwise(0)).alias("zero"), F.sum(F.when(zero, 0.0).otherwise(one / F.col("dist"))).alias("inverse"))


def cell_votes(found: DataFrame, keys: list[str], weights: Column) -> DataFrame:
    """(keys, label) that wins by ``votes`` with its zero rule, from cells with keys; weights: uniform or distance, the same for a key."""
    sums = found.groupBy(*keys, weights.alias("__weights"), "label").agg(*(F.sum(c).alias(c) for c in ("n", "zero", "inverse")))
    exact = F.max("zero").over(Window.partitionBy(*keys)) > 0
    w = F.when(F.col("__weights") == "uniform", F.col("n").cast("double")).when(exact, F.col("zero").cast("double")).otherwise(F.col("inverse"))
    order = Window.partitionBy(*keys).orderBy(F.col("w").desc(), "label")
    return sums.withColumn("w", F.round(w, 9)).withColumn("__k", F.row_number().over(order)).filter("__k = 1").select(*keys, "label")


def pointed(rows: DataFrame, by: str) -> DataFrame:
    """rows with point: the smallest id of the rows that share the value of ``by``, null where that is null."""
    return rows.join(rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min("id").alias("point")), by, "left")


def distinct_edges(queries: DataFrame, references: DataFrame, edges: Callable[[DataFrame, DataFrame, float], DataFrame], radius: float, by: str, radii: list | None = None) -> DataFrame:
    """(id, label, dist, copies) of pointed queries and references (id, template, ``by``, point): id is a query's point, and
    the references of one value and label are one edge. edges(queries, references, radius) gives (id, other, dist). With radii,
    the edges of vectors come as ``cells``."""
    one = lambda df: df.filter("id = point").dropDuplicates(["id"]).select("id", by)
    labels = references.filter("point is not null").groupBy(F.col("point").alias("other"), F.col("template").alias("label")).agg(F.count("*").alias("copies"))
    if edges is radius_join:
        return edges(one(queries), labels.join(one(references).select(F.col("id").alias("other"), by), "other"), radius)
    if edges is cosine_radius_join and radii:
        return cosine_cells(one(queries).withColumnRenamed(by, "v"), labels.join(one(references).select(F.col("id").alias("other"), F.col(by).alias("v")), "other"), radii)
    return edges(one(queries), one(references), radius).join(labels, "other").select("id", "label", "dist", "copies")


def predict(queries: DataFrame, winners: DataFrame, reject: str = OUTLIER) -> DataFrame:
    """queries (id, ...) with pred; without a neighbour: the reject token. Winners are of a query's point if it has one."""
    at = "point" if "point" in queries.columns else "id"
    return queries.hint("merge").join(winners.select(F.col("id").alias(at), F.col("label").alias("pred")).hint("merge"), at, "left").withColumn("pred", F.coalesce("pred", F.lit(reject)))


def sweep(queries: DataFrame, edges: DataFrame, radii: list, weights: tuple = ("uniform", "distance"), reject: str = OUTLIER) -> DataFrame:
    """One row (grid, radius, weights, id, truth, pred) for each combination and query (id, truth, perhaps point, to which edges refer).

    edges: (id, label, dist, perhaps copies) at the largest radius, summed once by label and radius; every combination sums these.
    """
    spark = queries.sparkSession
    rank = {r: i for i, r in enumerate(sorted(radii))}
    combos = [(i, float(r), w, rank[r]) for i, (r, w) in enumerate((r, w) for r in radii for w in weights)]
    grid = F.broadcast(spark.createDataFrame(combos, "grid int, radius double, weights string, last int"))  # the parameter grid
    met = cells(edges, radii).join(grid, F.col("bin") <= F.col("last"))
    grid = grid.drop("last")
    won = cell_votes(met, ["grid", "id"], F.col("weights"))
    at = "point" if "point" in queries.columns else "id"
    asked = queries.select("id", "truth", F.col(at).alias("__at")).join(grid)
    won = won.select("grid", F.col("id").alias("__at"), F.col("label").alias("pred"))
    met = asked.join(won, ["grid", "__at"], "left").drop("__at")
    return met.select("grid", "id", "truth", "radius", "weights", F.coalesce("pred", F.lit(reject)).alias("pred"))


def best_f1(results: DataFrame) -> DataFrame:
    """The combination with the best f1, the first of equals in grid order."""
    return results.orderBy(F.col("f1").desc(), "grid").limit(1)


def zero_rejection(results: DataFrame) -> DataFrame:
    """Of the combinations with full coverage, those of the smallest radius, and of these the best f1. Raises if there is none."""
    full = results.filter("coverage >= 1")
    if full.isEmpty():
        raise ValueError(f"no radius covers everything; best coverage {results.agg(F.max('coverage')).first()[0]}")
    return full.orderBy("radius", F.col("f1").desc(), "grid").limit(1)


def shared_keypoints(queries: DataFrame, refs: DataFrame, most: int = 27) -> DataFrame:
    """(query, ref, n): how many of a query's descriptors have a descriptor of the reference within ``most`` bits.

    Rows: (image, kp, d) with d an array of four longs. Of 16 bands of 16 bits, some band of two such descriptors differs in
    at most most // 16 bits, so probes with that many errors find every pair; descriptors are then compared in full.
    Distinct descriptors are compared once, however many images share one. Null descriptors match nothing. All joins are
    by sorting: rows are made of few (bands, errors), which Spark's estimates leave out, and a side taken for small would
    pass the driver. For the same reason descriptors are dealt to all cores before their rows are made.
    """
    parts = 4 * queries.sparkSession.sparkContext.defaultParallelism

    def bands(rows: DataFrame, name: str, masks: list[int]) -> DataFrame:
        own = rows.filter("d is not null").select(F.col("d").alias(name)).repartition(parts, name).distinct()
        part = [F.struct(F.lit(i).alias("b"), F.shiftrightunsigned(F.element_at(name, i // 4 + 1), 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF)).alias("x")) for i in range(16)]
        at = own.select(name, F.inline(F.array(*part)))
        return at.select(name, "b", F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("x").bitwiseXOR(m))).alias("v"))

    met = bands(queries, "p", band_masks(most // 16)).hint("merge").join(bands(refs, "q", [0]).hint("merge"), ["b", "v"])
    apart = sum((F.bit_count(F.element_at("p", i).bitwiseXOR(F.element_at("q", i))) for i in range(2, 5)), F.bit_count(F.element_at("p", 1).bitwiseXOR(F.element_at("q", 1))))
    near = met.filter(apart <= most).select("p", "q").distinct()
    asked = queries.select(F.col("image").alias("query"), "kp", F.col("d").alias("p"))
    held = refs.select(F.col("image").alias("ref"), F.col("d").alias("q")).distinct()
    return asked.hint("merge").join(near.hint("merge"), "p").hint("merge").join(held.hint("merge"), "q").select("query", "ref", "kp").distinct().groupBy("query", "ref").agg(F.count("*").alias("n"))


def graded_distance(matches: Column, keypoints: Column, least: int) -> Column:
    return F.when(matches >= least, 1 - F.least(matches / keypoints, F.lit(1.0))).otherwise(1.0)
