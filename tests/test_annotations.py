"""Annotation tables, pixel features and whole runs on small tables."""

import colorsys

import numpy as np
import pytest

from motifspark.operators import bootstrap, cluster, features, rows, runs
from motifspark.sources import annotations as A


def test_wide_models():
    found = A.wide_models(["image_id", "Net_Pred", "net_score", "b_label", "_pred", "c_template", "c_similarity", "c_conf"])
    assert found == {"Net": ("Net_Pred", "net_score"), "b": ("b_label", None), "c": ("c_template", "c_conf")}


def test_tables_without_the_columns_raise(spark):
    with pytest.raises(ValueError):
        A.truth_labels(spark.createDataFrame([("a", 1)], "name string, place int"), "place")
    with pytest.raises(ValueError):
        A.predictions(spark.createDataFrame([("a", 1)], "image_id string, place int"), "place")
    with pytest.raises(ValueError):
        A.labelled_rows(spark)


def test_truth_labels_take_the_first_row_then_drop_blanks(spark):
    t = spark.createDataFrame([(2, " a ", "x"), (1, "a", ""), (1, "b", " No Meme "), (1, None, "y"), (1, "c", None)], "place int, image_id string, label string")
    assert [tuple(r) for r in A.truth_labels(t, "place").collect()] == [("b", "Non-Meme")]


def test_seeds_of_paths(spark):
    t = spark.createDataFrame([("runs/seed40/x",), ("runs/seed_7",), ("runs/x",)], "p string")
    assert [r[0] for r in t.select(A.seed_of(t.p)).collect()] == [40, 7, None]
    assert A.seed_paths("a/{seed}/b{seed}", [1, 2]) == ["a/1/b1", "a/2/b2"]


def test_hue_saturation_value():
    rgb = np.random.default_rng(0).integers(0, 256, (300, 3)).astype(np.uint8)
    own = features.hue_saturation_value(rgb).astype(int)
    other = np.array([[int(255 * h), int(255 * s), int(v)] for h, s, v in (colorsys.rgb_to_hsv(*map(float, x)) for x in rgb)])
    assert np.abs(own - other).max() <= 1  # float32 against double
    assert features.hue_saturation_value(np.array([[7, 7, 7], [0, 0, 0]], np.uint8)).tolist() == [[0, 0, 7], [0, 0, 0]]


def test_texture_codes():
    flat = features.texture_codes(np.full((30, 30), 9, np.uint8), 24, 8)
    assert flat[15, 15] == 24  # all neighbours are as bright
    half = np.zeros((40, 40), np.uint8)
    half[:, 20:] = 200
    codes = features.texture_codes(half, 24, 8)
    assert codes[20, 10] == 24 and 11 <= codes[20, 20] <= 13  # right side of an edge: about half of the circle
    noise = np.random.default_rng(1).integers(0, 256, (40, 40)).astype(np.uint8)
    assert (features.texture_codes(noise, 24, 8) == 25).mean() > 0.5


def test_pixel_histograms(spark):
    pixels = np.zeros((20, 10, 3), np.uint8)
    pixels[:10] = (255, 0, 0)  # blue first
    images = spark.createDataFrame([("a", (20, 10, 3, bytearray(pixels.tobytes()))), ("g", (4, 4, 1, bytearray([8] * 16)))], "path string, image struct<height int, width int, nChannels int, data binary>")
    got = {r["path"]: np.array(r["v"]) for r in features.pixel_histograms(images).collect()}
    a, g = got["a"], got["g"]
    assert len(a) == len(g) == 4 * 256 + 28
    assert a[170] == 100 and a[512 + 255] == 100 and a[768 + 29] == 100 and a[768] == 100
    assert g[768 + 8] == 16 and abs(g[1024:].sum() - 1) < 1e-9


def test_embedded_skips_what_a_model_cannot_read(spark):
    t = spark.createDataFrame([(1, b"ab"), (2, b""), (3, None), (4, b"xyz")], "id int, content binary")
    models = {"n": lambda cs: [[len(c)] if len(c) else None for c in cs], "first": lambda cs: [[c[0], 1] if len(c) else [0, 0] for c in cs]}
    got = sorted(tuple(r) for r in features.embedded(t, models, 2).collect())
    assert got == [(1, [2.0], [97.0, 1.0]), (4, [3.0], [120.0, 1.0])]


def test_aligned_takes_the_last_row(spark):
    r = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "key string, place int, v string")
    k = spark.createDataFrame([("a",), ("a",)], "key string")
    assert [(x["key"], x["v"]) for x in rows.aligned(r, k, "key", "place").collect()] == [("a", "y")]


def test_no_named_cluster_raises(spark):
    m = spark.createDataFrame([(0, 5)], "cluster_id long, h long")
    with pytest.raises(ValueError):
        cluster.restrict_to_named(m, spark.createDataFrame([], "cluster_id long, template string"))


def test_binary_replicate_over_nothing(spark):
    r = spark.createDataFrame([(1, "m", "n", "n")], "id int, method string, truth string, pred string")
    w = spark.createDataFrame([(0, 1, 3)], "rep int, id int, w int")
    got = bootstrap.replicate_binary(r, w, ["method"], "id", "p").first()
    assert (got["precision"], got["recall"], got["f1"]) == (0.0, 0.0, 0.0)


def test_clusterer_by_name(spark):
    t = spark.createDataFrame([(i, [float(i % 2), 1.0 - i % 2]) for i in range(12)], "id long, v array<double>")
    got = {r["id"]: r["cluster_id"] for r in runs.clusterer("kmeans", t, k=2).collect()}
    assert len({got[0], got[1]}) == 2 and all(got[i] == got[i % 2] for i in got)
    with pytest.raises(ValueError):
        runs.clusterer("other", t)


def test_seed_batch(spark):
    r = spark.createDataFrame([("m", s, "a", "a" if s < 2 or k else "b") for s in (1, 2) for k in range(4)], "method string, seed int, truth string, pred string")
    each, summary = runs.seed_batch(r, ["accuracy"])
    assert sorted((x["seed"], x["accuracy"]) for x in each.collect()) == [(1, 1.0), (2, 0.75)]
    assert summary.first()["mean"] == 0.875
