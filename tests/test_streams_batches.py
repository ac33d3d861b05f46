"""Streamed assignment over restarts, and batches of runs that were cut off."""

import os
import time

import pytest

from motifspark.operators.cluster import open_predictions
from motifspark.operators.hashjoin import nearest_hash
from motifspark.sources import annotations, batches, files
from motifspark.streaming import assign

MEDOIDS = [(0, 0), (1, 255), (2, -1)]


def arrive(spark, folder, rows, name):
    """One file, later than those before."""
    spark.createDataFrame(rows, "id long, at timestamp, h long").coalesce(1).write.parquet(f"{folder}-{name}")
    part = next(f for f in os.listdir(f"{folder}-{name}") if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    os.link(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")
    at = time.time() + len(os.listdir(folder))
    os.utime(f"{folder}/{name}.parquet", (at, at))


def stamp(day, hour=0):
    import datetime

    return datetime.datetime(2024, 1, day, hour)


def test_assignment_restarts(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "out")
    medoids, names = spark.createDataFrame(MEDOIDS, "cluster_id long, h long"), spark.createDataFrame([(0, "zero"), (2, "ones")], "cluster_id long, template string")
    go = lambda: assign.drain(spark, folder, lambda d: d, "at", medoids, names, late="1 day", base=base)
    arrive(spark, folder, [(1, stamp(1), 1), (2, stamp(1, 5), 254), (2, stamp(1, 6), 254), (3, stamp(1), -2)], "a")
    first = {r.id: (r.cluster_id, r.pred_label) for r in go()["predictions"].collect()}
    assert first == {1: (0, "zero"), 2: (1, "Template-Free"), 3: (2, "ones")}
    arrive(spark, folder, [(1, stamp(1, 9), 1), (4, stamp(2), 3), (5, stamp(2), None)], "b")
    got = go()
    second = {r.id: (r.cluster_id, r.dist, r.pred_label) for r in got["predictions"].collect()}
    every = spark.createDataFrame([(1, 1), (2, 254), (3, -2), (4, 3), (5, None)], "id long, h long")
    assert second == {r.id: (r.cluster_id, r.dist, r.pred_label) for r in open_predictions(nearest_hash(every, medoids), names, "Template-Free").collect()}
    assert got["predictions"].count() == 5 and got["late"].count() == 0
    assert sum(r.n for r in got["counters"].collect()) == 5 and sum(r.rejected for r in got["counters"].collect()) == 2
    arrive(spark, folder, [(6, stamp(20), 0)], "c")
    go()
    arrive(spark, folder, [(7, stamp(2), 0), (8, stamp(20, 1), 0)], "d")
    got = go()
    assert {r.id for r in got["predictions"].collect()} == {1, 2, 3, 4, 5, 6, 8}
    assert [r.id for r in got["late"].collect()] == [7]
    assert go()["predictions"].count() == 7


def test_runs_taken_up_again(spark, tmp_path):
    root, wanted = str(tmp_path / "runs"), [("m", 1), ("m", 2), ("k", 1), ("m", 1)]
    called = []

    def run(method, seed, fail=None):
        called.append((method, seed))
        if (method, seed) == fail:
            raise RuntimeError("cut off")
        return spark.range(seed + 1).selectExpr("id AS sample_id", f"'{method}' AS pred")

    with pytest.raises(RuntimeError):
        batches.resume(spark, root, wanted, lambda m, s: run(m, s, ("m", 2)))
    spark.range(9).selectExpr("id AS sample_id", "'half' AS pred").write.parquet(f"{root}/rows/m/2-left")  # rows of a run that was cut off
    got = batches.resume(spark, root, wanted, run)
    assert called == [("m", 1), ("m", 2), ("m", 2), ("k", 1)]
    whole = batches.resume(spark, str(tmp_path / "other"), wanted, run)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(got.columns).collect()))
    n = len(called)
    assert batches.resume(spark, root, wanted, run).count() == 2 + 3 + 2 and len(called) == n
    assert {(r.method, r.seed): r.rows for r in batches.manifest(spark, root).collect()} == {("m", 1): 2, ("m", 2): 3, ("k", 1): 2}
    with pytest.raises(ValueError):
        batches.resume(spark, str(tmp_path / "none"), [], run)


def test_sinks_and_seed_runs(spark, tmp_path):
    rows = spark.createDataFrame([("a", 'x "y"\nz'), ("b", None)], "k string, v string")
    for form, back in (("parquet", spark.read.parquet), ("json", spark.read.json), ("csv", lambda p: files.delimited(spark, p))):
        files.put(rows, str(tmp_path / form), form)
        files.put(rows, str(tmp_path / form), form)
        assert sorted((r.k, r.v) for r in back(str(tmp_path / form)).collect()) == [("a", 'x "y"\nz'), ("b", None)]
    with pytest.raises(ValueError):
        files.put(rows, str(tmp_path / "x"), "xml")
    for method, seed in (("cnn", 40), ("cnn", 41), ("rnn", 40)):
        place = tmp_path / "r" / method / f"20240101_seed{seed}"
        place.mkdir(parents=True)
        (place / "open_set_predictions.csv").write_text("﻿sample_id,pred\n1,t\n", encoding="utf-8")
    got = annotations.seed_runs(spark, str(tmp_path / "r"))
    assert sorted((r.method, r.seed, r.sample_id, r.pred) for r in got.collect()) == [("cnn", 40, "1", "t"), ("cnn", 41, "1", "t"), ("rnn", 40, "1", "t")]
