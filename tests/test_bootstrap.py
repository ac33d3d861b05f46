"""The registered bootstrap's 10,000 replicates against plain Python."""

import hashlib
import math
import statistics

import numpy as np
import pytest

from motifspark.operators import bootstrap
from motifspark.plans import catalog

B, SEED = 10_000, 40
IDS = [3, 4, 8, 15, 16, 23, 42, 99]
ROWS = [(i, m, "abc"[i % 3], "abc"[(i + (i * k + k) % 4 // 2) % 3]) for k, m in enumerate(("m0", "m1", "m2", "m3")) for i in IDS]


def f1_of(pairs):
    n = len(pairs)
    f1 = 0.0
    for c in {t for t, _ in pairs} | {p for _, p in pairs}:
        t, p, d = sum(x == c for x, _ in pairs), sum(y == c for _, y in pairs), sum(x == y == c for x, y in pairs)
        f1 += t * 2 * d / (t + p)
    return f1 / n


@pytest.fixture(scope="module")
def plain():
    """{method: f1 of every replicate}."""
    of = {(i, m): (t, p) for i, m, t, p in ROWS}
    out = {m: [] for m in ("m0", "m1", "m2", "m3")}
    for rep in range(B):
        drawn = [IDS[int(hashlib.md5(f"{SEED}|{rep}|{k}".encode()).hexdigest()[:7], 16) % len(IDS)] for k in range(len(IDS))]
        for m, own in out.items():
            own.append(round(f1_of([of[i, m] for i in drawn]), 9))
    return out


@pytest.fixture(scope="module", autouse=True)
def stand_in(spark):
    """The registered queries, over ROWS."""
    table = spark.createDataFrame(ROWS, "sample_id long, method string, truth string, pred string")
    kept, catalog.S.predictions = catalog.S.predictions, lambda spark, d: table
    yield table
    catalog.S.predictions = kept


def test_intervals(spark, plain):
    got = {r.method: r for r in catalog.QUERIES["bootstrap_intervals_10000"](spark, "").filter("metric = 'f1'").collect()}
    assert set(got) == set(plain)
    for m, v in plain.items():
        lo, hi = np.percentile(v, [2.5, 97.5])
        assert [got[m].mean, got[m].lo, got[m].hi] == pytest.approx([np.mean(v), lo, hi], abs=1.01e-4)


def test_differences(spark, plain):
    got = {r.method: r for r in catalog.QUERIES["bootstrap_differences_10000"](spark, "").filter("metric = 'f1'").collect()}
    assert set(got) == {"m1", "m2", "m3"}
    for m, r in got.items():
        v = np.array(plain[m]) - np.array(plain["m0"])
        assert [r.mean, r.lo, r.hi] == pytest.approx([v.mean(), *np.percentile(v, [2.5, 97.5])], abs=1.01e-4)


def test_two_stage(spark, plain):
    for r in catalog.QUERIES["two_stage_bootstrap_10000"](spark, "").collect():
        own = [plain[m] for m in (("m0", "m1") if r.grp == "a" else ("m2", "m3"))]
        means = [statistics.fmean(v) for v in own]
        half = 4.302653 * math.sqrt(statistics.variance(means) / 2 + statistics.fmean(map(statistics.variance, own)) / (2 * B))
        mean = statistics.fmean(means)
        assert [r.mean, r.lo, r.hi] == pytest.approx([mean, mean - half, mean + half], abs=1.01e-4)


def test_pooled_as_weighted(stand_in):
    """Some ids without some methods, and a row twice: the scores of every replicate are those of the joined weights."""
    rows = stand_in.filter("not (sample_id = 8 and method = 'm1')").unionByName(stand_in.filter("sample_id = 23 and method = 'm2'"))
    pooled = bootstrap.pooled_scores(rows, "method", "sample_id", 30, SEED)
    joined = bootstrap.replicate_scores(rows, bootstrap.weights(rows, "sample_id", 30, SEED), ["method"], "sample_id")
    assert sorted(map(tuple, pooled.collect())) == sorted(map(tuple, joined.select(pooled.columns).collect()))


@pytest.mark.parametrize("n", [1, 7, 10, 123, 10_000, 25_001])
def test_draws_in_arrays(n):
    """The hashes of a replicate's draws are those of plain MD5, whatever the digits of replicate and draw."""
    from motifspark.operators import draws

    for seed, rep in ((SEED, 0), (SEED, 9_999), (7, 10), (12345, 321)):
        got = [int(p) for part in draws.positions(seed, rep, n, piece=2) for p in part]
        assert got == [int(hashlib.md5(f"{seed}|{rep}|{k}".encode()).hexdigest()[:7], 16) % n for k in range(n)]


@pytest.mark.parametrize("span, chunk", [(8, 4), (1 << 22, 7)])
def test_pooled_in_ranges(spark, span, chunk):
    """Positions in several ranges and chunks, null labels, a method that is missing; no row of the plan stands for a draw."""
    rows = [(i, m, None if i % 7 == 0 else "abc"[i % 3], "abc"[(i * i + (m == "b") * i) % 7 % 3]) for i in range(30) for m in ("a", "b") if (i, m) != (4, "b")]
    t = spark.createDataFrame(rows, "sample_id long, method string, truth string, pred string")
    pooled = bootstrap.pooled_scores(t, "method", "sample_id", 12, 7, span, chunk)
    assert "Range (" not in pooled._jdf.queryExecution().executedPlan().toString()
    joined = bootstrap.replicate_scores(t, bootstrap.weights(t, "sample_id", 12, 7), ["method"], "sample_id")
    assert sorted(map(tuple, pooled.collect())) == sorted(map(tuple, joined.select(pooled.columns).collect()))


@pytest.mark.parametrize("bucket", [1 << 14, 4])
def test_multinomial(spark, bucket):
    """Moments of the replicates are those of n draws with replacement; alike methods stay alike in every replicate."""
    rows = [(i, m, None if i % 31 == 0 else "abc"[i % 3], "abc"[(i * i + (m == "b") * i) % 7 % 3]) for i in range(400) for m in ("a", "a2", "b")]
    t = spark.createDataFrame(rows, "sample_id long, method string, truth string, pred string")
    got = bootstrap.multinomial_scores(t, "method", "sample_id", 2000, 7, bucket=bucket, block=300).toPandas()
    assert len(got) == 6000 and (got["n"] == 400).all()
    for m in ("a", "b"):
        own = got[got.method == m].set_index("rep")["accuracy"]
        q = sum(x == y for _, k, x, y in rows if k == m) / 400
        assert own.mean() == pytest.approx(q, abs=4 * math.sqrt(q * (1 - q) / 400 / 2000))
        assert own.var() == pytest.approx(q * (1 - q) / 400, rel=0.15)
    wide = got.pivot(index="rep", columns="method", values="f1")
    assert (wide["a"] == wide["a2"]).all() and (wide["a"] != wide["b"]).any()
    again = bootstrap.multinomial_scores(t.repartition(3), "method", "sample_id", 2000, 7, bucket=bucket, block=300).toPandas()
    assert got.sort_values(["rep", "method"]).values.tolist() == again.sort_values(["rep", "method"]).values.tolist()
    assert bootstrap.multinomial_scores(t.limit(0), "method", "sample_id", 10, 7).count() == 0
