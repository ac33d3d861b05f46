"""Whole runs as one call: the operators of a method, from labelled rows to predictions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import fuse, hamming, unit
from ..schema import OUTLIER, REJECTED_BY_STAGE1, TEMPLATE_FREE, TRAIN_SOURCE
from ..tables import settle
from . import cluster, densejoin, gate, hashjoin, linear, metrics, models, raters, replies, rows, sparse, vote
from .hdbscan import hdbscan


def canonical_split(items: DataFrame, key: str, exclude: tuple = ("meme_submissions",), least: int = 7, fraction: float = 0.8, seed: int = 40) -> DataFrame:
    """items with part (train, test): without excluded templates, then without those of fewer than ``least`` rows."""
    kept = rows.drop_small_classes(rows.exclude_templates(items, list(exclude)), least)
    return rows.stratified_split(kept, fraction, seed, key)


def hash_clusters(found: DataFrame, queries: DataFrame, radius: int = 8, min_samples: int = 5, top: int = 6, reject: str = TEMPLATE_FREE) -> dict[str, DataFrame]:
    """Clusters of hashes, named by their labelled members, and where queries fall.

    found: (id, h, template, source, image_path) of all rows that clusters are made from. queries: (id, h). Returns
    clusters (id, cluster_id, core), names (cluster_id, template), examples, counters, and predictions (id, closed_id,
    pred_template, open_id, dist, pred_label): the nearest named cluster, and the nearest of all, which rejects if unnamed.
    """
    clusters = settle(cluster.hash_dbscan(found.select("id", "h"), radius, min_samples), "run-clusters")
    members = found.join(clusters, "id")
    medoids = settle(cluster.medoids(members.select("id", "h", "cluster_id")).select("cluster_id", "h"), "run-medoids")
    names = settle(cluster.name_clusters(members), "run-names")
    own = members.join(medoids.withColumnRenamed("h", "m"), "cluster_id", "left")
    typical = own.withColumn("score", F.when(F.col("m").isNull(), F.lit(float("-inf"))).otherwise(-hamming(F.col("h"), F.col("m")).cast("double"))).drop("m")
    closed = hashjoin.nearest_hash(queries, cluster.restrict_to_named(medoids, names))
    every = hashjoin.nearest_hash(queries, medoids)
    closed = cluster.closed_predictions(closed.select("id", "cluster_id"), names).select("id", F.col("cluster_id").alias("closed_id"), "pred_template")
    every = cluster.open_predictions(every, names, reject).select("id", F.col("cluster_id").alias("open_id"), "dist", "pred_label")
    return {"clusters": clusters, "names": names, "examples": cluster.cluster_examples(typical.drop("template"), names, top), "counters": cluster.run_counters(members, names), "predictions": closed.join(every, "id")}


def vector_clusters(found: DataFrame, queries: DataFrame, clusters: DataFrame, steps: int = 1, top: int = 6, reject: str = TEMPLATE_FREE) -> dict[str, DataFrame]:
    """As ``hash_clusters`` for unit vectors v and given clusters (id, cluster_id), which are refined ``steps`` times first."""
    start = found.select("id", "v").join(clusters.select("id", "cluster_id"), "id")
    refined, centres = cluster.refine(start, steps)
    centres = settle(centres, "run-centres")
    members = settle(found.join(refined.select("id", "cluster_id"), "id"), "run-members")
    names = settle(cluster.name_clusters(members), "run-names")
    closed = densejoin.nearest_centroid(queries, cluster.restrict_to_named(centres, names))
    every = densejoin.nearest_centroid(queries, centres)
    closed = cluster.closed_predictions(closed.select("id", "cluster_id"), names).select("id", F.col("cluster_id").alias("closed_id"), "pred_template")
    every = cluster.open_predictions(every, names, reject).select("id", F.col("cluster_id").alias("open_id"), "score", "pred_label")
    typical = cluster.typicality(members, centres)
    return {"clusters": members.select("id", "cluster_id"), "names": names, "examples": cluster.cluster_examples(typical.drop("template"), names, top), "counters": cluster.run_counters(members, names), "predictions": closed.join(every, "id")}


def reduced_clusters(found: DataFrame, queries: DataFrame, dim: int | None = 128, method: str = "kmeans", k: int | None = None, steps: int = 1, seed: int = 40, top: int = 6, reject: str = TEMPLATE_FREE, min_samples: int | None = None, min_cluster_size: int = 10) -> dict[str, DataFrame]:
    """``vector_clusters`` of vectors v that are reduced to ``dim`` components first (None: as they are) and made unit vectors.

    found: (id, v, template, source, image_path); queries: (id, v). The reducer sees the rows of ``found`` only. method:
    kmeans, with k clusters (None: as many as labelled templates), or hdbscan. Rows whose vector is null or holds null or
    non-finite components are left out on both sides, as pictures are that a model can't read.
    """
    whole, asked = found.filter(densejoin.sound("v")), queries.filter(densejoin.sound("v"))
    if dim is not None:
        reduce = models.reducer(whole, dim)
        whole, asked = reduce(whole), reduce(asked)
    ready = lambda df, name: settle(df.withColumn("v", unit(F.col("v"))), name)
    whole, asked = ready(whole, "run-found"), ready(asked, "run-queries")
    if method == "kmeans" and k is None:
        k = whole.filter(F.col("source") == TRAIN_SOURCE).agg(F.count_distinct("template").alias("n")).first()["n"]
    start = settle(clusterer(method, whole.select("id", "v"), k=k or 2, seed=seed, min_samples=min_samples, min_cluster_size=min_cluster_size), "run-start")
    return vector_clusters(whole, asked, start, steps, top, reject) | {"reduced": whole.select("id", "v"), "start": start}


def fused_clusters(found: DataFrame, queries: DataFrame, alpha: float = 0.55, **options) -> dict[str, DataFrame]:
    """``reduced_clusters`` of two models' vectors a and b of each row, side by side with shares alpha and 1 - alpha.
    Rows without one of them are left out."""

    def joined(df: DataFrame) -> DataFrame:
        there = df.filter(densejoin.sound("a") & densejoin.sound("b"))
        return there.withColumn("v", fuse(F.col("a"), F.col("b"), alpha)).drop("a", "b")

    return reduced_clusters(joined(found), joined(queries), **options)


def radius_votes(train: DataFrame, test: DataFrame, edges: Callable[[DataFrame, DataFrame, float], DataFrame], radii: list, weights: tuple = ("uniform", "distance"), selection: str = "val_f1", val: float = 0.1, seed: int = 40, reject: str = OUTLIER, by: str = "h") -> dict[str, DataFrame]:
    """Radius votes with radius and weighting chosen on a part of the training rows.

    train, test: (id, template, ``by``); edges(queries, references, radius) gives (id, other, dist) of rows (id, ``by``).
    Distinct values meet once: references of one value and label vote by their number, and queries of one value share the
    outcome, so n queries and m references of a value cost one edge for each label.
    selection: val_f1, the best f1 of the whole grid, or zero_rejection, the smallest radius that rejects nothing.
    Returns search (grid, radius, weights, f1, coverage, covered_accuracy), selected (its chosen row) and predictions
    (id, template, pred).
    """
    dealt = settle(rows.stratified_split(train.select("id", "template", by), 1 - val, seed, "id"), "votes-split")
    fit, held = (settle(vote.pointed(dealt.filter(F.col("part") == p), by), "votes-points") for p in ("train", "test"))
    near = lambda q, r, radii: vote.distinct_edges(q, r, edges, max(radii), by, radii)
    swept = settle(vote.sweep(held.select("id", F.col("template").alias("truth"), "point"), near(held, fit, radii), radii, weights, reject), "votes-sweep")
    keys = ["grid", "radius", "weights"]
    search = settle(metrics.scores(swept, keys).select(*keys, "f1").join(metrics.coverage(swept, keys, reject).select("grid", "coverage", "covered_accuracy"), "grid"), "votes-search")
    selected = (vote.best_f1 if selection == "val_f1" else vote.zero_rejection)(search)
    best = selected.first()  # one row of the parameter grid
    asked, known = (settle(vote.pointed(settle(df.select("id", "template", by), "votes-rows"), by), "votes-points") for df in (test, train))
    won = vote.cell_votes(vote.cells(near(asked, known, [best["radius"]]), [best["radius"]]), ["id"], F.lit(best["weights"]))
    return {"search": search, "selected": selected, "predictions": vote.predict(asked.select("id", "template", "point"), won, reject).drop("point")}


def rated_truth(votes: DataFrame, raters_: int, breaks: DataFrame | None = None, keep_unsure: bool = False) -> dict[str, DataFrame]:
    """Ground truth of votes, and how far the raters agree, for all and in pairs."""
    return {"truth": raters.ground_truth(votes, breaks, keep_unsure), "agreement": raters.agreement(raters.codings(votes, keep_unsure), raters_), "pairs": raters.rater_pairs(votes)}


def seed_batch(runs: DataFrame, names: list[str] = ["f1", "mcc", "cohen_kappa"]) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(scores of each method and seed, their mean and deviation over seeds) of runs (method, seed, truth, pred), in one job."""
    each = metrics.scores(runs, ["method", "seed"])
    return each, metrics.seed_summary(each, ["method"], names)


def clusterer(method: str, rows_: DataFrame, k: int = 2, seed: int = 40, radius: int = 8, min_samples: int | None = None, min_cluster_size: int = 10) -> DataFrame:
    """(id, cluster_id) by name: kmeans or hdbscan of vectors (id, v), or dbscan of hashes (id, h; min_samples 5 if not given)."""
    if method == "kmeans":
        return cluster.kmeans(rows_, k, seed)[0]
    if method == "dbscan":
        return cluster.hash_dbscan(rows_, radius, min_samples or 5).select("id", "cluster_id")
    if method == "hdbscan":
        return hdbscan(rows_, min_cluster_size, min_samples)
    raise ValueError(f"no clusterer {method}")


def sparse_matching(train: DataFrame, test: DataFrame, order: str = "id", per_class: int = 30, cap: int | None = None, alpha: float = 0.35) -> dict[str, DataFrame]:
    """Sparse-representation matching of test vectors with the first ``per_class`` training vectors of each template.

    train, test: (id, template, v). Vectors are scaled position by position as the chosen references vary; ``cap`` bounds the
    test rows, dealt over templates. Returns predictions (id, template, pred, residual) and their scores.
    """
    refs = settle(rows.first_per_template(train, per_class, order).select("id", "template", "v"), "sparse-references")
    asked = (test if cap is None else rows.budgeted(test, cap, order)).select("id", "template", "v")
    moments = settle(models.position_moments(refs), "sparse-moments")
    scaled = lambda df: models.standardise(df, moments)
    found = sparse.sparse_match(scaled(asked).select("id", "v"), scaled(refs).select("id", F.col("template").alias("label"), "v"), alpha)
    predictions = settle(asked.select("id", "template").join(found.select("id", F.col("label").alias("pred"), "residual"), "id"), "sparse-predictions")
    return {"predictions": predictions, "scores": metrics.scores(predictions.withColumn("method", F.lit("sparse")), ["method"], "template")}


def keypoint_votes(train: DataFrame, test: DataFrame, points: DataFrame, radii: list, least: tuple = (20,), keypoints: int = 500, refs: int = 20, most: int = 27, weights: tuple = ("uniform", "distance"), val: float = 0.1, seed: int = 40, reject: str = OUTLIER) -> dict[str, DataFrame]:
    """Radius votes among the first ``refs`` references (by id) of each template, where distance falls with shared keypoints.

    train, test: (id, template). points: (id, kp, d) with the descriptors of both; an image without any is near to none.
    The number of matches that counts at all (``least``), the radius and the weighting are those with the best f1 on a part
    of the training rows. Pairs are matched once for all of them. Descriptors are written once, and joins of tables that grow
    with the rows are by sorting: what is small when written is not when the driver makes a hash table of it. Returns search (grid, least, radius, weights, f1, coverage,
    covered_accuracy), selected and predictions (id, template, pred).
    """
    dealt = settle(rows.stratified_split(train.select("id", "template"), 1 - val, seed, "id"), "keypoints-split")
    part = lambda p: dealt.filter(F.col("part") == p).drop("part")
    labels = train.select(F.col("id").alias("ref"), F.col("template").alias("label"))
    points = settle(points.select("id", "kp", "d"), "keypoints-points")
    of = lambda ids: points.hint("merge").join(ids.select("id").hint("merge"), "id", "left_semi").select(F.col("id").alias("image"), "kp", "d")

    def matched(queries: DataFrame, references: DataFrame) -> DataFrame:
        n = vote.shared_keypoints(of(queries), of(rows.first_per_template(references, refs, "id")), most)
        return settle(n.hint("merge").join(labels.hint("merge"), "ref").select(F.col("query").alias("id"), "label", "n"), "keypoints-matches")

    def graded(found: DataFrame, m: int) -> DataFrame:
        return found.select("id", "label", vote.graded_distance(F.col("n"), F.lit(float(keypoints)), m).alias("dist"))

    asked, found = part("test").select("id", F.col("template").alias("truth")), matched(part("test"), part("train"))
    swept = None
    for i, m in enumerate(least):
        one = vote.sweep(asked, graded(found, m).filter(F.col("dist") <= max(radii)), radii, weights, reject)
        one = one.withColumn("least", F.lit(m)).withColumn("grid", F.col("grid") + i * len(radii) * len(weights))
        swept = one if swept is None else swept.unionByName(one)
    swept, keys = settle(swept, "keypoints-sweep"), ["grid", "least", "radius", "weights"]
    search = settle(metrics.scores(swept, keys).select(*keys, "f1").join(metrics.coverage(swept, keys, reject).select("grid", "coverage", "covered_accuracy"), "grid"), "keypoints-search")
    selected = vote.best_f1(search)
    best = selected.first()  # one row of the parameter grid
    near = graded(matched(test, train), best["least"]).filter(F.col("dist") <= best["radius"])
    return {"search": search, "selected": selected, "predictions": vote.predict(test.select("id", "template"), vote.votes(near, ["id"], best["weights"]), reject)}


def _gated(calibrated_on: DataFrame, predicted: DataFrame, percent: float | None, fixed: float | None, to: str) -> tuple[DataFrame, DataFrame]:
    """(threshold row, predictions with those below it demoted); without percent and fixed none is."""
    if percent is None and fixed is None:
        return gate.calibrate(calibrated_on, 0, 0.0), predicted.withColumn("demoted", F.lit(False))
    cut = settle(gate.calibrate(calibrated_on, percent or 0, fixed), "run-threshold")
    at = cut.first()["threshold"]  # one row; null if nothing could be calibrated
    return cut, gate.apply_confidence(predicted, 0.0 if at is None else at, to)


def histogram_regression(train: DataFrame, test: DataFrame, percent: float | None = None, fixed: float | None = None, iterations: int = 1000, to: str = TEMPLATE_FREE) -> dict[str, DataFrame]:
    """Class-weighted regression on feature vectors; predictions less sure than ``percent`` of the training rows get ``to``.

    train, test: (id, template, v). The threshold comes from the training rows that the model was fitted on; a fixed one
    wins. Returns threshold, predictions (id, template, pred, confidence, demoted) and scores.
    """
    own = train.select("id", "v", F.col("template").alias("label"))
    both = own.withColumn("side", F.lit("train")).unionByName(test.select("id", "v", F.col("template").alias("label"), F.lit("test").alias("side")))
    said = settle(models.logistic(own, both, iterations=iterations).select("id", F.col("label").alias("template"), "pred", "confidence", "side"), "regression-said")
    fitted = said.filter("side = 'train'").select(F.col("template").alias("truth"), "confidence")
    cut, out = _gated(fitted, said.filter("side = 'test'").drop("side"), percent, fixed, to)
    return {"threshold": cut, "predictions": out, "scores": metrics.scores(out.withColumn("method", F.lit("regression")), ["method"], "template")}


def linear_head(train: DataFrame, test: DataFrame, val: float = 0.1, seed: int = 40, epochs: int = 50, patience: int = 5, percent: float | None = None, fixed: float | None = None, to: str = TEMPLATE_FREE) -> dict[str, DataFrame]:
    """A linear head over frozen vectors (id, template, v), stopped by its loss on ``val`` of the training rows; predictions
    that are not sure enough get ``to``, by a threshold from those held rows or a fixed one.

    Returns history (epoch, train_loss, loss), stop, threshold, predictions (id, template, pred, confidence, demoted) and scores.
    """
    dealt = settle(rows.stratified_split(train.select("id", "template", "v"), 1 - val, seed, "id"), "head-split")
    fit, held = (dealt.filter(F.col("part") == p).drop("part") for p in ("train", "test"))
    named = lambda df: df.select("v", F.col("template").alias("label"))
    model = linear.fit(named(fit), named(held), epochs, patience)
    seen = linear.predict(held, model).select(F.col("template").alias("truth"), "confidence")
    said = settle(linear.predict(test.select("id", "template", "v"), model).drop("v"), "head-said")
    cut, out = _gated(seen, said, percent, fixed, to)
    return {"history": model["history"], "stop": model["stop"], "threshold": cut, "predictions": out, "scores": metrics.scores(out.withColumn("method", F.lit("head")), ["method"], "template")}


def two_stages(validation: DataFrame, scored: DataFrame, reject: str = REJECTED_BY_STAGE1) -> dict[str, DataFrame]:
    """A gate before a classifier, with the threshold of the best geometric mean on validation rows.

    validation: (score, positive). scored: (id, template, p_meme, stage2_label). Without validation rows of both kinds no
    threshold is chosen and nothing is rejected. Returns sweep, predictions (id, template, pred, is_rejected) and coverage.
    """
    sweep = settle(gate.roc(validation), "gate-sweep")
    chosen = sweep.filter("selected").first()  # one row at most
    out = gate.two_stage(scored, 0.0 if chosen is None else chosen["threshold"], reject).select("id", "template", "pred", "is_rejected")
    return {"sweep": sweep, "predictions": out, "coverage": metrics.coverage(out.withColumn("method", F.lit("gate")), ["method"], reject, "template")}


def replied(train: DataFrame, test: DataFrame, answers: DataFrame, shots: int = 1, seed: int = 40) -> dict[str, DataFrame]:
    """Prompts for every test row, and its model's answer read back into a label and scored.

    train, test: (template, image_path). answers: (image_path, payload, error, latency_seconds, total_tokens); a test row
    without an answer, or whose payload is null, counts as an invalid one. The label space is the training templates in
    order, indexed from 0. Returns prompts (image_path, prompt), predictions (image_path, truth, template_pred, valid,
    match_mode, finish_reason), metrics and scores.
    """
    from ..functions.labels import label_index

    space = settle(label_index(train.select("template")).select(F.col("label_idx").cast("int").alias("label_idx"), "label"), "reply-labels")
    prompts = replies.prompts(test, space, replies.pick_examples(train, shots, seed))
    met = test.select("image_path", F.col("template").alias("truth")).join(answers, "image_path", "left")
    met = met.withColumn("raw_response_text", replies.payload_text(F.col("payload"))).withColumn("finish_reason", replies.finish_reason(F.col("payload"))).drop("payload")
    out = settle(replies.resolve(met, space).withColumn("method", F.lit("replies")), "reply-predictions")
    return {"prompts": prompts, "predictions": out.drop("method"), "metrics": replies.reply_metrics(out, ["method"]), "scores": metrics.scores(out, ["method"], "truth", "template_pred")}


def pseudo_labels(train: DataFrame, held: DataFrame, seed: int = 40) -> tuple[DataFrame, DataFrame]:
    """(id, label) of training vectors (id, v) by k-means, and of held vectors by the nearest centre scaled to length one;
    k is a hundredth of the rows, from 32 to 1024, and never more than there are rows."""

    own, model = cluster.kmeans(train, cluster.pseudo_label_k(train.count()), seed)
    centres = train.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id long, v array<double>")
    near = densejoin.nearest_centroid(held.select("id", "v"), centres.select("cluster_id", unit(F.col("v")).alias("v")))
    return own.withColumnRenamed("cluster_id", "label"), near.select("id", F.col("cluster_id").alias("label"))
