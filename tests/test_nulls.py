"""Null rows, one class only and odd white space: a defined result, never a crash."""

from pyspark.sql import functions as F

from motifspark.functions import labels as L
from motifspark.functions import urls as U
from motifspark.operators import densejoin, gate, hashjoin, metrics, raters, runs

FOUND = "id long, h long, template string, source string, image_path string"


def test_null_hashes(spark):
    q = spark.createDataFrame([(1, 7), (2, None), (3, 7)], "id long, h long")
    reps = spark.createDataFrame([(5, 6), (4, None), (6, 7)], "cluster_id long, h long")
    assert {(r.id, r.cluster_id, r.dist) for r in hashjoin.nearest_hash(q, reps).collect()} == {(1, 6, 0), (2, None, None), (3, 6, 0)}
    assert {r.cluster_id for r in hashjoin.nearest_hash(q, reps.filter("false")).collect()} == {None}
    for radius in (3, 20):
        assert {(r.id, r.other) for r in hashjoin.radius_join(q, q, radius).collect()} == {(a, b) for a in (1, 3) for b in (1, 3)}
    found = spark.createDataFrame([(i, 9 if i < 8 else None, "t1", "imgflip_train", f"p{i}") for i in range(9)], FOUND)
    out = runs.hash_clusters(found, q)["predictions"].collect()
    assert {(r.id, r.pred_label) for r in out} == {(1, "t1"), (2, "Template-Free"), (3, "t1")}
    votes = runs.radius_votes(found.select("id", "h", "template"), found.select((F.col("id") + 100).alias("id"), "h", "template"), hashjoin.radius_join, [3, 20])
    assert {r.pred for r in votes["predictions"].filter("id = 108").collect()} == {"__OUTLIER__"}


def test_null_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 0.0])], "id long, v array<double>")
    centres = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, None)], "cluster_id long, v array<double>")
    assert {(r.id, r.cluster_id) for r in densejoin.nearest_centroid(v, centres).collect()} == {(1, 1), (2, None), (3, None), (4, None)}
    assert [(r.id, r.other) for r in densejoin.cosine_radius_join(v, v, 0.5).collect()] == [(1, 1)]


def test_one_class_only(spark):
    votes = spark.createDataFrame([(i, f"r{r}", "TEMPLATE") for i in range(4) for r in range(3)], "image_id long, annotator string, kind string")
    assert {r.kappa for r in raters.agreement(raters.codings(votes, False), 3).collect()} == {1.0}
    roc = gate.roc(spark.createDataFrame([(0.1, True), (0.7, True)], "score double, positive boolean")).collect()
    assert {(r.fpr, r.gmean, r.selected) for r in roc} == {(None, None, False)} and {r.tpr for r in roc} == {0.5, 1.0}
    assert metrics.timing(spark.createDataFrame([("a", 0.0)], "k string, s double"), ["k"], "s").first().per_hour is None


def test_white_space_and_odd_addresses(spark):
    rows = spark.createDataFrame([("N/A\t",), ("Foo Bar\r",), (" x　\n",)], "t string")
    assert [r[0] for r in rows.select(L.clean(F.col("t"))).collect()] == [None, "Foo Bar", "x"]
    said = {"https://www.youtube.com/watch?v=a|b": None, "https://imgur.com/a/x y": None, "https://twitter.com/a/b?q={x}": None, "https://imgur.com/GGs[1]": "https://i.imgur.com/GGs[1].jpg", "imgur.com/a/z": "imgur.com/a/z", "https://i.redd.it/q\n": "https://i.redd.it/q", "//imgur.com/GGs": "https://i.imgur.com/GGs.jpg", "https://imgur.com/u/v": None, "https://ex.com/p.PNG": "https://ex.com/p.PNG", "": None, "https://m.imgur.com/a.PNG?x=1": "https://m.imgur.com/a.PNG?x=1"}
    got = spark.createDataFrame([(u,) for u in said], "u string").select("u", U.direct_url(F.col("u")).alias("d")).collect()
    assert {r.u: r.d for r in got} == said
