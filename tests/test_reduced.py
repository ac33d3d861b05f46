"""Fused and reduced clusters against numpy, and the counters of rows that go."""

import numpy as np
from pyspark.sql import functions as F

from motifspark.functions.vectors import unit
from motifspark.operators import cluster, models, rows, runs

SHAPE = "id long, a array<double>, b array<double>, template string, source string, image_path string"


def unit_rows(v):
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def test_unit(spark):
    t = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, []), (4, [1e-13])], "id int, v array<double>")
    got = {r.id: r.u for r in t.select("id", unit(F.col("v")).alias("u")).collect()}
    assert got == {0: [0.6, 0.8], 1: [0.0, 0.0], 2: None, 3: [], 4: [0.1]}


def test_fused_clusters(spark):
    r = np.random.default_rng(9)
    kind = np.arange(60) % 3
    a, b = np.eye(3)[kind] * 4 + 0.2 * r.normal(size=(60, 3)), np.eye(4)[kind] * 2 + 0.2 * r.normal(size=(60, 4))
    side = lambda i: ("imgflip_test" if i % 5 == 0 else "social_media" if i % 4 == 0 or kind[i] == 2 else "imgflip_train")
    table = [(i, [float(x) for x in a[i]], [float(x) for x in b[i]], f"t{kind[i]}", side(i), f"p{i}") for i in range(60)]
    table += [(98, None, [1.0] * 4, "t0", "imgflip_train", "x"), (99, [float("nan")] * 3, [1.0] * 4, "t0", "imgflip_test", "y")]
    t = spark.createDataFrame(table, SHAPE)
    out = runs.fused_clusters(t.filter("source <> 'imgflip_test'"), t.filter("source = 'imgflip_test'").select("id", "a", "b"), dim=4, k=3)
    fused = unit_rows(np.hstack([0.55**0.5 * a, 0.45**0.5 * b]))
    own = [i for i in range(60) if side(i) != "imgflip_test"]
    mean = fused[own].mean(0)
    axes = np.linalg.svd(fused[own] - mean, full_matrices=False)[2][:4]
    want = unit_rows((fused - mean) @ axes.T)
    reduced = {x.id: np.array(x.v) for x in out["reduced"].collect()}
    assert sorted(reduced) == own
    got = np.array([reduced[i] for i in own])
    assert np.allclose(got @ got.T, want[own] @ want[own].T, atol=1e-9)  # axes have no sign
    found = {x.id: x.cluster_id for x in out["clusters"].collect()}
    groups = [{found[i] for i in own if kind[i] == k} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set().union(*groups)) == 3
    said = {x.id: x for x in out["predictions"].collect()}
    assert sorted(said) == [i for i in range(60) if side(i) == "imgflip_test"]
    centres = {k: unit_rows(want[[i for i in own if kind[i] == k]].mean(0, keepdims=True))[0] for k in range(3)}
    for i, x in said.items():  # the third kind has no labelled member
        assert x.pred_label == ("Template-Free" if kind[i] == 2 else f"t{kind[i]}")
        assert x.pred_template == f"t{max((0, 1), key=lambda k: want[i] @ centres[k])}"
        assert abs(x.score - max(want[i] @ c for c in centres.values())) < 1e-9


def test_no_more_components_than_positions(spark):
    t = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(5)], "id long, v array<double>")
    assert {len(r.v) for r in models.pca(t, t, 128).collect()} == {2}


def test_counters(spark):
    t = spark.createDataFrame([("a", "p1")] * 3 + [("b", "p2")] * 2 + [("c", None)], "template string, path string")
    assert [r[:] for r in rows.removed_classes(t, 3).orderBy("n").collect()] == [("c", 1), ("b", 2)]
    assert {r[:] for r in rows.excluded_count(t, ["a", "z", "a"]).collect()} == {("a", 3), ("z", 0)}
    assert {r[0] for r in rows.missing_templates(["a", " x ", "", "x"], t).collect()} == {"x"}
    assert rows.missing_templates([], t).count() == 0
    assert rows.missing_paths(t, "path", spark.createDataFrame([("p1",), ("p1",), (None,)], "path string")).collect()[0][:] == (6, 3)
    n = spark.range(10)
    done = F.col("id") % 2 == 0
    assert [rows.until(n, "id", done, m).count() for m in (0, 1, 2, 5, 6)] == [0, 1, 3, 9, 10]
    said = spark.createDataFrame([("UNKNOWN_CLUSTER",), ("a",)], "pred_template string")
    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "id int, other int")
    assert cluster.prediction_counters(said, edges).collect()[0][:] == (1, 2)
    assert cluster.prediction_counters(said).collect()[0][:] == (1, 0)
