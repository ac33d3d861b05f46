"""The cosine radius join by pivot cells against all pairs, and what it leaves out."""

import numpy as np
import pytest

from motifspark.operators import densejoin

SHAPE = "id long, v array<double>"


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(v)], SHAPE)


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def pairs(a, b, radius):
    d = 1 - a @ b.T
    return {(int(i), int(j)): d[i, j] for i, j in zip(*np.nonzero(d <= radius))}


@pytest.mark.parametrize("radius", [0.0005, 0.05, 0.6, 2.0])
def test_equal_to_all_pairs(spark, radius):
    r = np.random.default_rng(3)
    centres = unit(r.normal(size=(9, 8)))
    b = unit(centres[r.integers(0, 9, 260)] + 0.05 * r.normal(size=(260, 8)))
    b[100:190] = b[0]  # one vector on a third of the rows
    a = np.vstack([unit(b[:70] + 0.01 * r.normal(size=(70, 8))), unit(r.normal(size=(30, 8))), b[:1], np.zeros((1, 8))])
    got = densejoin.cosine_radius_join(frame(spark, a), frame(spark, b), radius, tile=16).collect()
    want = {k: x for k, x in pairs(a, b, radius).items() if abs(x - radius) > 1e-12}
    assert len(got) == len({(x.id, x.other) for x in got})
    assert {(x.id, x.other) for x in got if abs(x.dist - radius) > 1e-12} == set(want)
    assert all(abs(x.dist - want[x.id, x.other]) < 1e-9 for x in got if (x.id, x.other) in want)


def test_vectors_of_other_norms(spark):
    r = np.random.default_rng(4)
    a, b = r.normal(size=(60, 5)) * r.uniform(0.1, 3, (60, 1)), r.normal(size=(80, 5)) * r.uniform(0.1, 3, (80, 1))
    got = {(x.id, x.other) for x in densejoin.cosine_radius_join(frame(spark, a), frame(spark, b), 0.1, tile=8).collect()}
    assert got == set(pairs(a, b, 0.1))


def test_far_groups_do_not_meet(spark):
    r = np.random.default_rng(5)
    centres = unit(r.normal(size=(20, 32)))
    b = unit(np.repeat(centres, 100, 0) + 0.02 * r.normal(size=(2000, 32)))
    a = unit(np.repeat(centres, 20, 0) + 0.02 * r.normal(size=(400, 32)))
    _, _, zones = densejoin.radius_zones(frame(spark, a), frame(spark, b), 0.05, tile=100)
    assert sum(z["n"] * z["asked"] for z in zones) < 0.1 * len(a) * len(b)
    assert {(x.id, x.other) for x in densejoin.cosine_radius_join(frame(spark, a), frame(spark, b), 0.05, tile=100).collect()} == set(pairs(a, b, 0.05))


def test_empty_sides(spark):
    v, none = frame(spark, np.eye(3)), spark.createDataFrame([], SHAPE)
    for a, b in ((v, none), (none, v), (none, none)):
        assert densejoin.cosine_radius_join(a, b, 0.5).collect() == []
    assert densejoin.cosine_radius_join(v, frame(spark, -np.eye(3)), 0.5).collect() == []


@pytest.mark.parametrize("labels, least", [(3, 1024), (3, 16), (90, 16)])
def test_cells_are_summed_where_blocks_meet(spark, monkeypatch, labels, least):
    """Edges left their tasks and met their labels by a join: as many rows as near pairs."""
    from motifspark.operators import vote
    from pyspark.sql import functions as F

    monkeypatch.setattr(densejoin, "LEAST_BLOCK", least)
    monkeypatch.setattr(densejoin, "BLOCK_BYTES", 8 * 6 * 70)  # 70 rows, if not fewer
    r, radii = np.random.default_rng(labels), [0.6, 0.01, 0.2]
    b = np.round(unit(r.normal(size=(150, 6))), 3)
    b[90:110], a = b[0], np.vstack([b[:30], unit(r.normal(size=(60, 6)))])
    frames = [[(i, f"t{r.integers(labels)}", v) for i, v in enumerate([*x.tolist(), None, [float("nan")] * 6])] for x in (a, b)]
    asked, known = (vote.pointed(spark.createDataFrame(f, "id long, template string, v array<double>"), "v") for f in frames)
    edges = vote.distinct_edges(asked, known, densejoin.cosine_radius_join, 0.6, "v")
    cells = vote.distinct_edges(asked, known, densejoin.cosine_radius_join, 0.6, "v", radii)
    want = {(x.id, x.label, x.bin): x for x in vote.cells(edges, radii).collect()}
    got = {(x.id, x.label, x.bin): x for x in cells.collect()}
    assert set(got) == set(want) and cells.count() == len(got)
    assert all((x.n, x.zero) == (want[k].n, want[k].zero) or want[k].bin == 0 and x.n == want[k].n for k, x in got.items())
    truth = asked.select("id", F.col("template").alias("truth"), "point")
    rows = lambda e: sorted(map(tuple, vote.sweep(truth, e, radii).collect()))
    assert rows(cells) == rows(edges)


def test_no_cells_of_empty_sides(spark):
    v = frame(spark, np.eye(3))
    held = v.selectExpr("id AS other", "v", "'t' AS label", "1L AS copies")
    for a, b in ((v, held.limit(0)), (v.limit(0), held)):
        assert densejoin.cosine_cells(a, b, [0.5]).collect() == []
