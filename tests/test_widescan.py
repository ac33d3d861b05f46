"""Density clusters of hashes within a wide radius against all pairs."""

import random

import pytest

from motifspark.operators import cluster, widescan


def plain(rows, radius, least):
    """{id: (cluster, core)} by the rules of the queries' SQL."""
    ids = sorted({i for i, _ in rows})
    near = lambda x, y: x is not None and y is not None and (x ^ y).bit_count() <= radius
    met = {i: [b for a, x in rows for b, y in rows if a == i and b != i and near(x, y)] for i in ids}
    core = {i for i in ids if sum(a == i for a, _ in rows) * len(met[i]) + 1 >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            number, todo = len(set(label.values())), [i]
            while todo:
                k = todo.pop()
                if k not in label:
                    label[k] = number
                    todo += [b for b in met[k] if b in core]
    border = lambda i: min((label[b] for b in met[i] if b in core), default=-1)
    return {i: (label[i], True) if i in core else (border(i), False) for i in ids}


@pytest.mark.parametrize("least", [2, 4, 7])
@pytest.mark.parametrize("spread", [12, 18])
def test_equal_to_all_pairs(spark, monkeypatch, least, spread):
    """Several tiles and blocks, few anchors, ids of several rows, copies, nulls."""
    r = random.Random(10 * least + spread)
    bases = [r.getrandbits(63) for _ in range(9)]
    flip = lambda h: h ^ sum(1 << b for b in r.sample(range(63), spread))
    rows = [(i, flip(r.choice(bases))) for i in range(90)] + [(i, r.getrandbits(63)) for i in range(90, 120)]
    rows += [(i % 40 * 3, r.choice(rows)[1]) for i in range(25)] + [(7, None), (300, None), (5, rows[5][1]), (301, rows[5][1])]
    monkeypatch.setattr(widescan, "ANCHORS", 3)
    got = widescan.wide_dbscan(spark.createDataFrame(rows, "id long, h long"), 20, least, tile=16, block=48).collect()
    assert sorted(x.id for x in got) == sorted(i for i, _ in rows)
    assert {x.id: (x.cluster_id, x.core) for x in got} == plain(rows, 20, least)


def test_near_pairs_are_not_listed(spark, monkeypatch):
    """A crowd of 2,000 hashes within the radius was 4 million edges."""
    monkeypatch.setattr(cluster, "near_hashes", None)
    r = random.Random(1)
    rows = [(i, sum(1 << b for b in r.sample(range(63), 10))) for i in range(2000)]
    out, written = cluster.hash_dbscan(spark.createDataFrame(rows, "id long, h long"), 20, 4), []
    assert {(x.cluster_id, x.core) for x in out.collect()} == {(0, True)}
    settle = widescan.settle
    monkeypatch.setattr(widescan, "settle", lambda df, name: written.append(settle(df, name)) or written[-1])
    points = spark.createDataFrame(rows, "id long, h long").selectExpr("h", "1L AS n", "0L AS margin").distinct()
    widescan.degrees(points, 20, 4, 256, 1024).collect()
    widescan.parts(points.select("h"), spark.createDataFrame([], "src long, dst long"), 20, 256, 1024).collect()
    assert max(df.count() for df in written) <= 2000


def test_nothing_to_cluster(spark):
    rows = spark.createDataFrame([(1, None), (2, None)], "id long, h long")
    assert {(x.id, x.cluster_id, x.core) for x in cluster.hash_dbscan(rows, 20, 1).collect()} == {(1, -1, False), (2, -1, False)}
