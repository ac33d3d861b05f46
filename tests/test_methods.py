"""Whole methods against plain versions, and their odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark.operators import gate, linear, models, replies, rows, runs


def vectors(spark, n, seed):
    r = np.random.default_rng(seed)
    c = np.arange(n) % 3
    x = np.eye(3)[c] + r.normal(size=(n, 3)) * 0.4
    return spark.createDataFrame([(i, f"t{c[i]}", [float(a) for a in x[i]]) for i in range(n)], "id long, template string, v array<double>")


def test_regression_with_a_gate(spark):
    t = vectors(spark, 90, 1)
    train, test = t.filter("id % 3 < 2 or id % 2 = 0"), t.filter("id % 2 = 1")
    got = runs.histogram_regression(train, test, percent=20)
    own = {r.id: r for r in models.logistic(train.withColumnRenamed("template", "label"), t.withColumnRenamed("template", "label")).collect()}
    cut = np.percentile([own[r.id].confidence for r in train.collect()], 20)
    assert got["threshold"].first().threshold == pytest.approx(cut, abs=1e-6)
    said = {r.id: r for r in got["predictions"].collect()}
    assert set(said) == {r.id for r in test.collect()}
    for i, r in said.items():
        if abs(r.confidence - cut) > 1e-5:
            assert r.demoted == (r.confidence < cut) and r.pred == ("Template-Free" if r.demoted else own[i].pred)
    assert any(r.demoted for r in said.values()) and got["scores"].first().n == len(said)
    assert not any(r.demoted for r in runs.histogram_regression(train, test)["predictions"].collect())


def test_linear_head_as_its_parts(spark):
    t = vectors(spark, 90, 2)
    train, test = t.filter("id < 60"), t.filter("id >= 60")
    got = runs.linear_head(train, test, val=0.25, epochs=3, percent=10)
    dealt = {r.id: r.part for r in rows.stratified_split(train, 0.75, 40, "id").collect()}
    part = lambda p: train.filter(train.id.isin([i for i, q in dealt.items() if q == p]))
    named = lambda df: df.withColumnRenamed("template", "label")
    model = linear.fit(named(part("train")), named(part("test")), 3)
    assert [tuple(r) for r in got["history"].orderBy("epoch").collect()] == [pytest.approx(tuple(r)) for r in model["history"].orderBy("epoch").collect()]
    cut = np.percentile([r.confidence for r in linear.predict(part("test"), model).collect()], 10)
    assert got["threshold"].first().threshold == pytest.approx(cut, abs=1e-6)
    raw = {r.id: r for r in linear.predict(test, model).collect()}
    for r in got["predictions"].collect():
        assert r.pred == ("Template-Free" if r.demoted else raw[r.id].pred) and r.confidence == pytest.approx(raw[r.id].confidence)


def test_keypoints(spark):
    """Images without descriptors, more references than are used, and two numbers of matches to choose from."""
    r = np.random.default_rng(3)
    base = r.integers(-(2**62), 2**62, (4, 6, 4))
    items, points = [], []
    for i in range(64):
        c = i % 4
        items.append((i, f"t{c}", "test" if i % 5 == 0 else "train"))
        if i % 16 != 15:
            points += [(i, k, [int(x) ^ int(r.integers(0, 4)) for x in base[c][k]]) for k in range(6 if i % 3 else 3)]
    t = spark.createDataFrame(items, "id long, template string, part string")
    p = spark.createDataFrame(points, "id long, kp int, d array<long>")
    train, test = (t.filter(f"part = '{x}'").drop("part") for x in ("train", "test"))
    got = runs.keypoint_votes(train, test, p, [0.4, 0.6], (2, 4), 6, refs=3)
    assert got["search"].count() == 8 and {r.least for r in got["search"].collect()} == {2, 4}
    best = got["selected"].first()
    assert best.f1 == max(r.f1 for r in got["search"].collect())
    of = {}
    for i, _, d in points:
        of.setdefault(i, []).append(d)
    refs = [i for c in range(4) for i in [j for j, x, s in items if s == "train" and x == f"t{c}"][:3]]
    near = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b)) <= 27
    for row in got["predictions"].collect():
        w = {}
        for j in refs:
            n = sum(any(near([v & (2**64 - 1) for v in a], [v & (2**64 - 1) for v in b]) for b in of.get(j, [])) for a in of.get(row.id, []))
            d = 1 - min(n / 6, 1) if n >= best.least else 1.0
            if d <= best.radius:
                w.setdefault(items[j][1], []).append(d)
        if best.weights == "distance":
            zero = any(d == 0 for ds in w.values() for d in ds)
            score = {k: round(sum(d == 0 if zero else 1 / d for d in ds), 9) for k, ds in w.items()}
        else:
            score = {k: len(ds) for k, ds in w.items()}
        assert row.pred == (min(score, key=lambda k: (-score[k], k)) if score else "__OUTLIER__")


def test_two_stages_and_roc(spark):
    """By hand: six scores; the middle one of three alike steps goes; one class only chooses nothing."""
    v = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.6, True), (0.5, False), (0.4, False), (None, True)], "score double, positive boolean")
    got = [tuple(r) for r in gate.roc_points(v).orderBy(F.col("threshold").desc()).collect()]
    third = round(1 / 3, 6)
    g = lambda t, f: round((t * (1 - f)) ** 0.5, 6)
    assert got == [(float("inf"), 0.0, 0.0, 0.0, False), (0.8, round(2 / 3, 6), 0.0, g(2 / 3, 0), True), (0.7, round(2 / 3, 6), third, g(2 / 3, 1 / 3), False), (0.6, 1.0, third, g(1, 1 / 3), False), (0.4, 1.0, 1.0, 0.0, False)]
    scored = spark.createDataFrame([(1, "a", 0.85, "a"), (2, "a", 0.1, "a"), (3, "b", None, "a")], "id long, template string, p_meme double, stage2_label string")
    run = runs.two_stages(v.dropna(), scored)
    assert {r.id: r.pred for r in run["predictions"].collect()} == {1: "a", 2: "__REJECTED_BY_STAGE1__", 3: "a"}
    assert run["coverage"].first().rejected_count == 1
    one = v.filter("positive")
    assert [r.gmean for r in gate.roc_points(one).collect()] == [None] * gate.roc_points(one).count()
    assert not any(r.is_rejected for r in runs.two_stages(one, scored)["predictions"].collect())
    assert gate.roc_points(v.limit(0)).count() == 0


def test_replies(spark):
    train = spark.createDataFrame([("A", "a1"), ("B", "b2"), ("B", "b1")], "template string, image_path string")
    test = spark.createDataFrame([("A", "q1"), ("B", "q2"), ("B", "q3")], "template string, image_path string")
    answers = spark.createDataFrame([("q1", '{"choices":[{"message":{"content":"{\\"template_id\\": 0}"},"finish_reason":"stop"}]}', "", 1.0, 5), ("q2", None, "timeout", 3.0, None)], "image_path string, payload string, error string, latency_seconds double, total_tokens long")
    got = runs.replied(train, test, answers, shots=2)
    assert {r.image_path: (r.template_pred, r.match_mode) for r in got["predictions"].collect()} == {"q1": ("A", "index"), "q2": ("__INVALID_TEMPLATE__", "invalid"), "q3": ("__INVALID_TEMPLATE__", "invalid")}
    m = got["metrics"].first()
    assert (m.n, m.n_invalid, m.n_errors, m.n_truncated, m.accuracy_valid, m.mean_latency, m.total_tokens) == (3, 2, 1, 0, 1.0, 2.0, 5)
    p = {r.image_path: r.prompt for r in got["prompts"].collect()}
    assert p["q1"].startswith("Templates:\n[0] A\n[1] B\nuser: <image:") and p["q1"].endswith("user: <image:q1>") and "<image:b1>" in p["q1"]
    none = runs.replied(train, test, answers, shots=0)["prompts"].filter("image_path = 'q1'").first().prompt
    assert none == "Templates:\n[0] A\n[1] B\nuser: <image:q1>"
    with pytest.raises(ValueError):
        replies.pick_examples(train, 3, 40)


def test_pseudo_labels(spark):
    t = vectors(spark, 120, 5)
    own, held = runs.pseudo_labels(t.filter("id < 100").select("id", "v"), t.filter("id >= 100").select("id", "v"))
    of = {r.id: r.label for r in own.collect()}
    assert len(of) == 100 and 2 <= len(set(of.values())) <= 32
    x = {r.id: np.array(r.v) for r in t.collect()}
    centres = {c: np.mean([x[i] for i in of if of[i] == c], axis=0) for c in set(of.values())}
    for r in held.collect():
        scores = {c: x[r.id] @ m / np.linalg.norm(m) for c, m in centres.items()}
        assert scores[r.label] >= max(scores.values()) - 1e-6
