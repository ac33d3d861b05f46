"""The linear head against a plain loop and the conditions of an optimum."""

import numpy as np
import pytest

from motifspark.operators import linear


def table(spark, x, y):
    return spark.createDataFrame([(i, y[i], [float(a) for a in r]) for i, r in enumerate(x)], "id long, label string, v array<double>").repartition(5)


def draw(n, seed):
    r = np.random.default_rng(seed)
    y = r.integers(0, 3, n)
    return np.eye(3, 4)[y] + r.normal(size=(n, 4)) * 0.8, [f"t{c}" for c in y]


def plain(x, y, xh, yh, epochs, patience, l2):
    """(history of losses on held rows, best epoch, stopped epoch, weights of the best)."""
    labels = sorted(set(y))
    one = lambda a: np.c_[a, np.ones(len(a))]
    x, xh, t, th = one(x), one(xh), np.array([labels.index(c) for c in y]), np.array([labels.index(c) for c in yh])
    ridge = np.array([l2] * (x.shape[1] - 1) + [0])
    step = np.linalg.inv(x.T @ x / len(x) / 2 + np.diag(ridge))
    w, best, losses = np.zeros((len(labels), x.shape[1])), (np.inf, -1, None), []
    prob = lambda a: (e := np.exp(a @ w.T)) / e.sum(1, keepdims=True)
    for e in range(epochs + 1):
        losses.append(-np.log(prob(xh)[np.arange(len(th)), th]).mean())
        if losses[-1] < best[0]:
            best = (losses[-1], e, w)
        if e - best[1] >= patience:
            break
        w = w - ((prob(x) - np.eye(len(labels))[t]).T @ x / len(x) + w * ridge) @ step
    return losses, best[1], len(losses) - 1, best[2]


def test_history_and_stop_as_a_plain_loop(spark):
    (x, y), (xh, yh) = draw(60, 1), draw(40, 2)
    losses, best, stopped, w = plain(x, y, xh, yh, 60, 3, 0.0)
    assert best < stopped < 60
    got = linear.fit(table(spark, x, y), table(spark, xh, yh), 60, 3, 0.0)
    assert [r.loss for r in got["history"].orderBy("epoch").collect()] == pytest.approx(losses)
    s = got["stop"].first()
    assert (s.best_epoch, s.stopped_epoch) == (best, stopped) and s.best_loss == pytest.approx(min(losses))
    assert np.allclose(got["weights"], w)
    own = [r.train_loss for r in got["history"].orderBy("epoch").collect()]
    assert all(b <= a + 1e-12 for a, b in zip(own, own[1:]))


def test_optimum_without_held_rows(spark):
    x, y = draw(80, 3)
    t = table(spark, x, y)
    got = linear.fit(t, t.limit(0), epochs=40, l2=0.1)
    x1, w = np.c_[x, np.ones(80)], got["weights"]
    e = np.exp(x1 @ w.T)
    slope = (e / e.sum(1, keepdims=True) - np.eye(3)[[int(c[1]) for c in y]]).T @ x1 / 80 + w * [0.1] * 1 * np.r_[np.ones(4), 0]
    assert np.abs(slope).max() < 1e-5
    assert got["stop"].first().stopped_epoch == 40


def test_odd_rows(spark):
    x, y = draw(30, 4)
    t = table(spark, x, y)
    bad = spark.createDataFrame([(100, "t0", None), (101, "t1", [1.0, None, 0.0, 0.0]), (102, None, [1.0, 0.0, 0.0, 0.0]), (103, "new", [1.0, 0.0, float("nan"), 0.0])], t.schema)
    unknown = spark.createDataFrame([(200, "never", [1.0, 0.0, 0.0, 0.0])], t.schema)
    held = t.filter("id < 10")
    a, b = linear.fit(t, held, 4), linear.fit(t.unionByName(bad), held.unionByName(unknown).unionByName(bad), 4)
    assert a["labels"] == b["labels"] == ["t0", "t1", "t2"]
    assert not np.allclose(a["weights"], 0) and np.allclose(a["weights"], b["weights"])
    out = {r.id: r for r in linear.predict(t.unionByName(bad), a).collect()}
    assert len(out) == 34 and out[100].pred is None and out[101].confidence is None and out[102].pred in a["labels"]
    assert all(1 / 3 <= out[i].confidence <= 1 for i in range(30))
    assert linear.predict(t.limit(0), a).count() == 0
    with pytest.raises(ValueError):
        linear.fit(t.limit(0), t)
    kept, linear.MOST_BYTES = linear.MOST_BYTES, 10
    with pytest.raises(ValueError):
        linear.fit(t, t)
    linear.MOST_BYTES = kept
