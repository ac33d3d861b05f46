"""Sparse matching with a divided dictionary against the plain solver that holds all of it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifspark.operators import metrics, models, rows, runs, sparse

DIMS = 24


@pytest.fixture(scope="module")
def planted():
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, DIMS))
    make = lambda n: [(int(i), f"t{k:02d}", centres[k] + r.normal(size=DIMS) * 0.3) for i, k in enumerate(r.integers(0, 12, n))]
    return make(150), make(24)


def frame(spark, items):
    return spark.createDataFrame([(i, t, None if v is None else [None if x is None else float(x) for x in v]) for i, t, v in items], "id long, label string, v array<double>")


def plain(refs, asked, alpha):
    """{id: (label, residual)} with the whole dictionary at once."""
    atoms = {}
    for _, t, v in refs:
        atoms[tuple(v)] = min(t, atoms.get(tuple(v), t))
    atoms = sorted((t, v) for v, t in atoms.items())
    a, names = np.array([v for _, v in atoms]), np.array([t for t, _ in atoms])
    y = np.array([v for _, _, v in asked])
    x = models.lasso(a, y, alpha, 3000, 1e-9)
    out = {}
    for i, (k, _, _) in enumerate(asked):
        left = {t: np.linalg.norm(y[i] - x[i, names == t] @ a[names == t]) for t in sorted(set(names))}
        best = min(left, key=lambda t: (round(left[t], 7), t))
        out[k] = best, left[best]
    return out


@pytest.mark.parametrize("alpha, part, block", [(0.05, 40, 12), (0.35, 40, 12), (0.02, 1000, 200)])
def test_equal_to_the_whole_dictionary(spark, planted, alpha, part, block):
    refs, asked = planted
    counts = []
    got = sparse.sparse_match(frame(spark, asked).drop("label"), frame(spark, refs), alpha, part=part, block=block, counts=counts).collect()
    want = plain(refs, asked, alpha)
    assert {r.id: r.label for r in got} == {i: t for i, (t, _) in want.items()}
    assert max(abs(r.residual - want[r.id][1]) for r in got) < 1e-5
    assert counts[0] == -(-150 // part) * -(-24 // block) and counts[-1] <= counts[0]


def test_codes_are_optimal():
    r = np.random.default_rng(2)
    a, y, level = r.normal(size=(40, 8)), r.normal(size=(6, 8)), 0.8
    x = sparse.sparse_codes(a, y, level)
    slope = (y - x @ a) @ a.T
    assert np.all(np.abs(slope) <= level + 1e-7) and np.allclose(slope[x != 0], level * np.sign(x[x != 0]), atol=1e-6) and (x != 0).any()
    assert np.allclose(sparse.sparse_codes(a, y, level, x), x, atol=1e-7)


def test_parts_far_from_a_query_are_screened(spark):
    """Two groups of classes in positions of their own: in the end no query needs the other group's parts."""
    r = np.random.default_rng(9)
    side = lambda k: np.where(np.arange(DIMS) // 12 == k, r.normal(size=DIMS) + 2, r.normal(size=DIMS) * 0.01)
    refs = [(i, f"t{i % 2}", side(i % 2)) for i in range(400)]
    counts = []
    sparse.sparse_match(frame(spark, [(i, "", side(0)) for i in range(20)]), frame(spark, refs), 0.05, part=4, block=50, counts=counts).collect()
    assert counts[0] == 100 and counts[-1] < 100


def test_odd_rows(spark, planted):
    refs, asked = planted
    odd = [(900, "x", None), (901, "x", [None] * DIMS), (902, "x", [float("nan")] * DIMS), (903, "x", [1.0]), (904, "x", [0.0] * DIMS), (905, "x", asked[0][2]), (905, "x", asked[0][2])]
    bad = [(7000, None, asked[0][2]), (7001, "a", None), (7002, "a", [float("inf")] * DIMS), (7003, "t00", [0.0] * DIMS), (7004, "zz", refs[3][2])]
    got = sparse.sparse_match(frame(spark, asked[:3] + odd), frame(spark, refs + bad), 0.05).collect()
    want = plain(refs, asked[:3], 0.05)
    assert sorted(r.id for r in got) == sorted([i for i, _, _ in asked[:3] + odd])
    by = {r.id: r for r in got}
    assert all(by[i].label is None and by[i].residual is None for i in (900, 901, 902, 903))
    assert by[904].label == "t00" and by[904].residual == 0  # nothing to explain: the first label
    assert by[905].label == want[asked[0][0]][0] and all(by[i].label == want[i][0] for i in want)
    assert [r.label for r in sparse.sparse_match(frame(spark, asked[:2]), frame(spark, []), 0.05).collect()] == [None, None]
    assert sparse.sparse_match(frame(spark, []), frame(spark, refs), 0.05).count() == 0


def test_run(spark, planted):
    refs, asked = planted
    named = lambda x: frame(spark, x).withColumnRenamed("label", "template")
    got = runs.sparse_matching(named(refs), named(asked), per_class=5, cap=40, alpha=0.1)
    first = [r for t in sorted({t for _, t, _ in refs}) for r in sorted((x for x in refs if x[1] == t), key=lambda x: x[0])[:5]]
    x = np.array([v for _, _, v in first])
    mean, std = x.mean(0), x.std(0)
    chosen = {r.id for r in rows.budgeted(named(asked), 40, "id").collect()}
    scale = lambda items: [(i, t, (v - mean) / std) for i, t, v in items]
    want = plain(scale(first), scale([a for a in asked if a[0] in chosen]), 0.1)
    assert {r.id: r.pred for r in got["predictions"].collect()} == {i: t for i, (t, _) in want.items()} and len(want) <= 40
    truth = {i: t for i, t, _ in asked}
    score = got["scores"].first()
    assert score.accuracy == pytest.approx(np.mean([truth[i] == t for i, (t, _) in want.items()]), abs=1e-6)
    assert isinstance(metrics.scores(got["predictions"].withColumn("m", F.lit(1)), ["m"], "template").columns, list)
