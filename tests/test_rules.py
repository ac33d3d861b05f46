"""Hand-worked cases of single rules."""

import random

import pytest
from pyspark.sql import functions as F

from motifspark.functions import labels as L
from motifspark.functions import urls as U
from motifspark.functions import vectors as V
from motifspark.operators import cluster, gate, graph, metrics, raters, replies, rows, vote
from motifspark.operators.graph import connected_components


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_scores(spark):
    r = metrics.scores(table(spark, [(1, "a", "a"), (1, "a", "b"), (1, "b", "b"), (1, "b", "b")], "k int, truth string, pred string"), ["k"]).first()
    assert (r.accuracy, r.precision, r.recall, r.f1, r.mcc, r.cohen_kappa) == (0.75, 0.833333, 0.75, 0.733333, 0.57735, 0.5)
    r = metrics.scores(table(spark, [(1, "a", "a")], "k int, truth string, pred string"), ["k"]).first()
    assert r.degenerate and r.cohen_kappa == 0 and r.mcc == 0


def test_votes(spark):
    e = table(spark, [(1, "a", 1.0), (1, "b", 2.0), (1, "b", 2.0)], "id int, label string, dist double")
    assert vote.votes(e, ["id"]).first().label == "b"
    assert vote.votes(e, ["id"], "distance").first().label == "a"
    z = table(spark, [(1, "a", 0.0), (1, "b", 1.0), (1, "b", 1.0), (1, "b", 1.0)], "id int, label string, dist double")
    assert vote.votes(z, ["id"], "distance").first().label == "a"


def test_zero_rejection_raises(spark):
    with pytest.raises(ValueError):
        vote.zero_rejection(table(spark, [(0, 0.1, 0.9, 0.99)], "grid int, radius double, f1 double, coverage double"))


def test_naming_ties(spark):
    r = table(spark, [(1, "b", "imgflip_train"), (1, "a", "imgflip_train"), (2, "c", "social_media"), (-1, "a", "imgflip_train")], "cluster_id long, template string, source string")
    assert {x.cluster_id: x.template for x in cluster.name_clusters(r).collect()} == {1: "a"}


def test_dbscan_path(spark):
    e = table(spark, [(1, 2), (2, 1), (2, 3), (3, 2)], "id long, other long")
    got = {r.id: (r.cluster_id, r.core) for r in cluster.dbscan(spark.range(1, 5), e, 3).collect()}
    assert got == {1: (0, False), 2: (0, True), 3: (0, False), 4: (-1, False)}


def test_components(spark):
    e = table(spark, [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (200, 200)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}


def test_labels(spark):
    t = table(spark, [("Non-Meme",), ("not a meme",), ("template free",), ("none",), ("",)], "x string")
    got = {r.x: (r.canonical, r.kind) for r in L.canonical_label(t, "x").withColumn("kind", L.label_kind(F.col("x"))).collect()}
    assert got == {"Non-Meme": ("Non-Meme", "NON_MEME"), "not a meme": ("Non-Meme", "NON_MEME"), "template free": ("Template-Free", "TEMPLATELESS"), "none": ("none", "TEMPLATELESS"), "": ("", "TEMPLATELESS")}


def test_hex_hash(spark):
    t = table(spark, [("01" + "00" * 7,), ("80" + "00" * 7,), ("00" * 7 + "80",)], "x string")
    assert [r[0] for r in t.select(V.hex_hash(F.col("x"))).collect()] == [1, 128, -(2**63)]


def test_urls(spark):
    cases = {None: None, "https://youtube.com/x": None, "https://imgur.com/a/z": None, "https://imgur.com/GGs": "https://i.imgur.com/GGs.jpg", "https://imgur.com/u/v": None, "https://i.redd.it/q": "https://i.redd.it/q", "https://ex.com/p.PNG": "https://ex.com/p.PNG", "youtube.com/x": "youtube.com/x"}
    t = table(spark, [(k,) for k in cases], "u string")
    assert {r.u: r.d for r in t.select("u", U.direct_url(F.col("u")).alias("d")).collect()} == cases


def test_confidence_gate(spark):
    t = table(spark, [("t1", 0.6), ("Non-Meme", 0.1), ("t2", 0.8)], "pred string, confidence double")
    assert [r.pred for r in gate.apply_confidence(t, 0.7).collect()] == ["Template-Free", "Non-Meme", "t2"]


def test_early_stop(spark):
    t = table(spark, [("r", i, x) for i, x in enumerate([5.0, 4.0, 4.0, 3.0, 3.5, 3.6, 1.0])], "run string, epoch int, loss double")
    r = gate.early_stop(t, ["run"], 2).first()
    assert (r.best_epoch, r.best_loss, r.stopped_epoch) == (3, 3.0, 5)


def test_split_sizes(spark):
    t = spark.range(1530).select(F.concat(F.lit("t"), F.col("id") % 17).alias("template"), "id")
    cut = rows.stratified_split(t, 0.8, 40, "id")
    assert cut.filter("part = 'train'").count() == 1224
    assert cut.groupBy("template").agg(F.count_if("part = 'train'" and F.col("part") == "train").alias("n")).agg(F.min("n"), F.max("n")).first()[:] == (72, 72)


def test_ground_truth(spark):
    v = [(1, "TEMPLATE", "Drake-Hotline"), (1, "TEMPLATE", "drake_hotline"), (1, "TEMPLATE", "Two Buttons"), (1, "TEMPLATELESS", ""), (1, "UNSURE", ""), (2, "TEMPLATE", ""), (2, "NON_MEME", ""), (3, "junk", "")]
    t = table(spark, [(i, f"r{k}", k, kind, name) for k, (i, kind, name) in enumerate(v)], "image_id long, annotator string, ord int, kind string, name string")
    assert [tuple(r) for r in raters.ground_truth(t).collect()] == [(1, "Drake-Hotline", "TEMPLATE", 5, 3)]
    b = table(spark, [(2, "TEMPLATE", "x"), (1, "NON_MEME", "")], "image_id long, kind string, label string")
    assert {tuple(r) for r in raters.ground_truth(t, b).collect()} == {(1, "Drake-Hotline", "TEMPLATE", 5, 3), (2, "x", "TEMPLATE", 2, 1)}


def test_replies(spark):
    labels = table(spark, [(i, f"Tpl {i}") for i in range(10)], "label_idx int, label string")
    cases = {'{"template_id": true}': "invalid", '{"template_id": 3}': "index", '{"template_id": 3.0}': "index", '{"template_id": "[3]"}': "index", '{"template_id": [3]}': "index", '{"template_id": 3.5}': "invalid", '{"template_id": "x"}': "invalid", '{"template_id": 99}': "invalid", '```json\n{"template_id": 4}\n```': "index", 'noise {"template_id": 4} tail': "index", "nope": "invalid", '{"template": "Tpl 2"}': "name_exact", '{"template": "tpl-2"}': "name_lenient"}
    got = replies.resolve(table(spark, [(k,) for k in cases], "raw_response_text string"), labels)
    assert {r.raw_response_text: r.match_mode for r in got.collect()} == cases


def test_hash_dbscan(spark):
    """A hash that 100,000 rows share is one point; counts of rows make core points; null hashes are noise."""
    many = spark.range(100_000).select("id", F.lit(0).cast("long").alias("h"))
    few = spark.createDataFrame([(200_000, 1), (200_001, -1), (200_002, -1), (200_003, -1), (200_004, None), (200_005, 1 << 40)], "id long, h long")
    got = cluster.hash_dbscan(many.unionByName(few), 1, 3)
    assert [tuple(r) for r in got.filter("id < 100000").groupBy("cluster_id", "core").count().collect()] == [(0, True, 100_000)]
    rest = {r.id: (r.cluster_id, r.core) for r in got.filter("id >= 100000").collect()}
    assert rest == {200_000: (0, True), 200_001: (1, True), 200_002: (1, True), 200_003: (1, True), 200_004: (-1, False), 200_005: (0, True)}


def test_numbered(spark):
    values = spark.range(5000).select((F.col("id") * 7919 % 10007).alias("v")).unionByName(spark.createDataFrame([(None,), (3,), (3,)], "v long"))
    got = [tuple(r) for r in graph.numbered(values, "v", "n").orderBy("n").collect()]
    assert got == [(v, i) for i, v in enumerate(sorted({i * 7919 % 10007 for i in range(5000)} | {3}))]


def test_shared_keypoints_against_all_pairs(spark):
    import random

    from motifspark.operators.vote import shared_keypoints

    dice = random.Random(3)
    word = lambda: [dice.randrange(-(1 << 63), 1 << 63) for _ in range(4)]
    def flip(x, i):
        y = (x & ((1 << 64) - 1)) ^ (1 << i)
        return y - (1 << 64) if y >> 63 else y

    base = [word() for _ in range(6)]

    def near(d):
        d = list(d)
        for bit in dice.sample(range(256), dice.choice([0, 20, 26, 27, 28, 29])):
            d[bit // 64] = flip(d[bit // 64], bit % 64)
        return d

    q = [(i % 10, i, near(dice.choice(base))) for i in range(60)] + [(99, 0, None)]
    r = [(i % 8, i, near(dice.choice(base))) for i in range(60)] + [(99, 0, None)]
    apart = lambda a, b: sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(a, b))
    hits = {(a, b, k) for a, k, d in q for b, _, e in r if d and e and apart(d, e) <= 27}
    wanted = sorted((a, b, sum(1 for h in hits if h[:2] == (a, b))) for a, b in {h[:2] for h in hits})
    shape = "image int, kp int, d array<long>"
    got = shared_keypoints(spark.createDataFrame(q, shape), spark.createDataFrame(r, shape))
    assert sorted(tuple(x) for x in got.collect()) == wanted and wanted


def test_votes_of_one_hash_on_very_many_rows(spark):
    """100,000 references and as many queries share a hash: their edges are one for each label, not 10^10."""
    from motifspark.operators import hashjoin, runs

    n = 100000
    train = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("template"), F.lit(5).cast("long").alias("h")).unionByName(spark.range(n, n + 40).selectExpr("id", "'c' AS template", "255L << 20 AS h"))
    test = spark.range(2 * n, 3 * n).selectExpr("id", "'b' AS template", "IF(id % 1000 = 0, 255L << 20, IF(id % 1000 = 1, NULL, 5L)) AS h")
    got = runs.radius_votes(train, test, hashjoin.radius_join, [2, 4])["predictions"].groupBy("pred").count().collect()
    assert {r[:] for r in got} == {("b", n - 200), ("c", 100), ("__OUTLIER__", 100)}


def test_votes_by_distinct_values_are_those_of_rows(spark):
    from motifspark.operators import hashjoin, vote

    r = random.Random(6)
    q, refs = ([(i, f"t{r.randrange(3)}", r.choice([0, 1, 3, 7, 255, None])) for i in range(40)] for _ in range(2))
    a, b = (vote.pointed(spark.createDataFrame(t, "id long, template string, h long"), "h") for t in (q, refs))
    near = vote.distinct_edges(a, b, hashjoin.radius_join, 2, "h")
    for weights in ("uniform", "distance"):
        got = {x.id: x.pred for x in vote.predict(a, vote.votes(near, ["id"], weights)).collect()}
        for i, _, h in q:
            score = {}
            found = [] if h is None else [(t, (h ^ g).bit_count()) for _, t, g in refs if g is not None and (h ^ g).bit_count() <= 2]
            zero = any(d == 0 for _, d in found)
            for t, d in found:
                score[t] = score.get(t, 0) + (1 if weights == "uniform" else (d == 0) if zero else 1 / d)
            want = min(score, key=lambda t: (-round(score[t], 9), t)) if score else "__OUTLIER__"
            assert got[i] == want
