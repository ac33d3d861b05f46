"""Models against numpy, sources and the stream on small files."""

import math
import os
import struct
import zlib

import numpy as np
import pytest

from motifspark.operators import features, models, sparse
from motifspark.sources import files
from motifspark.streaming import rates


def vectors(spark, x, labels=None):
    return spark.createDataFrame([(i, None if labels is None else labels[i], [float(v) for v in row]) for i, row in enumerate(x)], "id long, label string, v array<double>")


def png(path, pixels):
    """A gray PNG."""
    rows = b"".join(b"\0" + bytes(r) for r in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_standardise_and_pca(spark):
    x = np.random.default_rng(1).normal(size=(40, 5)) * [1, 2, 3, 4, 0]
    t = vectors(spark, x)
    got = np.array([r.v for r in models.standardise(t, models.position_moments(t)).orderBy("id").collect()])
    s = x.std(0)
    assert np.allclose(got, (x - x.mean(0)) / np.where(s > 1e-12, s, 1))
    got = np.array([r.v for r in models.pca(t, t, 2).orderBy("id").collect()])
    u = (x - x.mean(0)) @ np.linalg.svd(x - x.mean(0))[2][:2].T
    assert np.allclose(np.abs(got), np.abs(u), atol=1e-8)


def test_lasso_is_optimal():
    r = np.random.default_rng(2)
    a, y, alpha = r.normal(size=(12, 8)), r.normal(size=(6, 8)), 0.1
    x = models.lasso(a, y, alpha, 5000, 1e-10)
    slope = (y - x @ a) @ a.T / 8
    assert np.all(np.abs(slope) <= alpha + 1e-6)
    assert np.allclose(slope[x != 0], alpha * np.sign(x[x != 0]), atol=1e-6) and (x != 0).any()


def test_sparse_match_and_logistic(spark):
    r = np.random.default_rng(3)
    labels = [f"t{i % 3}" for i in range(60)]
    x = np.eye(3)[[i % 3 for i in range(60)]] + r.normal(size=(60, 3)) * 0.05
    t = vectors(spark, x, labels)
    got = {m.id: m.label for m in sparse.sparse_match(t.filter("id >= 30"), t.filter("id < 30"), alpha=0.01, block=8).collect()}
    assert got == {i: labels[i] for i in range(30, 60)}
    out = models.logistic(t.filter("id < 30"), t.filter("id >= 30")).collect()
    assert len(out) == 30 and all(o.pred == o.label and 1 / 3 < o.confidence <= 1 for o in out)
    assert sparse.sparse_match(t.filter("id < 0"), t).count() == 0


def test_images(spark, tmp_path):
    grid = [[(7 * i * i + 13 * j) % 256 for j in range(32)] for i in range(32)]
    png(tmp_path / "a" / "x.png", grid)
    png(tmp_path / "b" / "c" / "y.PNG", [[5, 9], [9, 5]])
    (tmp_path / "a" / "bad.png").write_bytes(b"no image")
    (tmp_path / "a" / "note.txt").write_bytes(b"text")
    rows = files.labelled_folder(spark, str(tmp_path), "imgflip").collect()
    assert {(os.path.basename(r.image_path), r.template) for r in rows} == {("x.png", "a"), ("bad.png", "a")}
    assert files.corpus(spark, [str(tmp_path), str(tmp_path / "a")]).count() == 3
    found = {os.path.basename(r.path): np.array(r.v) for r in features.gray_grids(files.images(spark, str(tmp_path)), 32).collect()}
    assert set(found) == {"x.png", "y.PNG"}
    assert np.allclose(found["x.png"], np.array(grid).reshape(-1), atol=1e-6)
    t = spark.createDataFrame([("x", found["x.png"].tolist()), ("null", None)], "id string, v array<double>")
    got = {r.id: r.h for r in features.dct_hash(t, 32).collect()}
    i = np.arange(32)
    basis = np.array([np.cos(np.pi * (2 * i + 1) * k / 64) * (np.sqrt(1 / 32) if k == 0 else np.sqrt(2 / 32)) for k in range(8)])
    low = (basis @ np.array(grid) @ basis.T).reshape(-1)
    want = sum(1 << int(k) for k in np.flatnonzero(low > np.median(low[1:])))
    assert got == {"x": want - (1 << 64 if want >> 63 else 0), "null": None}


def test_resampling():
    """Two dark and two bright squares, worked out beforehand; a plain image and one of the size asked for stay as they are."""
    squares = np.full((16, 16), 255 - 0xE1, np.uint8)
    squares[:8, :8] = squares[8:, 8:] = 0xE1
    half = features.resized(squares, 8).astype(int)
    assert half[:4, :4].tolist() == [[0xE1, 0xE0, 0xE4, 0xD7], [0xE0, 0xDF, 0xE3, 0xD6], [0xE4, 0xE3, 0xE7, 0xDA], [0xD7, 0xD6, 0xD9, 0xCE]]
    assert abs(half - half.T).max() <= 1 and (half == half[::-1, ::-1]).all()  # rows are rounded before columns
    assert (features.resized(np.full((50, 7), 93, np.uint8), 32) == 93).all()
    noise = np.random.default_rng(1).integers(0, 256, (32, 32)).astype(np.uint8)
    assert (features.resized(noise, 32) == noise).all()
    assert features.resized(np.array([[0, 255]], np.uint8), 4)[0].tolist() == plain_row([0, 255], 4)


def plain_row(row, pixels):
    """One row resampled value by value with the weights' definition."""
    n, out = len(row), []
    wide = max(n / pixels, 1)
    for k in range(pixels):
        w = []
        for i in range(n):
            x = (i + 0.5 - (k + 0.5) * n / pixels) / wide
            w.append(0 if abs(x) >= 3 else 1 if x == 0 else 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x) ** 2)
        out.append(min(255, max(0, round(sum(v * a for v, a in zip(row, w)) / sum(w)))))
    return out


def test_gray_bytes():
    raw = np.array([[[255, 255, 255], [0, 0, 255], [255, 0, 0], [0, 255, 0]]], np.uint8)  # white, red, blue, green
    assert features.gray_bytes(raw).tolist() == [[255, 76, 29, 150]]


def test_tables(spark, tmp_path):
    spark.createDataFrame([("p", "t")], "path string, template_name string").write.parquet(str(tmp_path / "s1"))
    spark.createDataFrame([("q", "u", "z")], "image_path string, template string, source string").write.parquet(str(tmp_path / "s2"))
    spark.range(2).write.parquet(str(tmp_path / "s3"))
    assert files.split_table(spark, str(tmp_path / "s1")).collect()[0][:] == ("p", "t", "imgflip")
    assert {r[:] for r in files.split_pair(spark, str(tmp_path / "s1"), str(tmp_path / "s2")).collect()} == {("p", "t", "imgflip_train"), ("q", "u", "imgflip_test")}
    with pytest.raises(ValueError):
        files.split_table(spark, str(tmp_path / "s3"))
    (tmp_path / "runs" / "m1" / "seed_1").mkdir(parents=True)
    text = '\ufeffsample_id,pred_label\n1,"a ""b"""\n'
    (tmp_path / "runs" / "m1" / "seed_1" / "open_set_predictions.csv").write_text(text, encoding="utf-8")
    (tmp_path / "runs" / "open_set_predictions.csv").write_text(text, encoding="utf-8")
    got = files.runs(spark, str(tmp_path / "runs")).select("sample_id", "pred_label", "method").collect()
    assert {r[:] for r in got} == {("1", 'a "b"', "m1"), ("1", 'a "b"', "")}
    t = spark.createDataFrame([("x\ny", 'q"r')], "a string, b string")
    files.write_delimited(t, str(tmp_path / "out"))
    assert files.delimited(spark, str(tmp_path / "out")).collect() == t.collect()


def test_stream(spark, tmp_path):
    at = str(tmp_path / "in")
    events = spark.sql("SELECT timestamp_seconds(id * 600) AS ts, concat('k', id % 2) AS kind, double(id) AS value FROM range(100)")
    events.repartition(3).write.parquet(at)
    got = {(r.start, r.kind): (r.n, r.total) for r in rates.drain(spark, at, "ts", "kind", "value").collect()}
    want = events.groupBy("kind", "ts").agg({"value": "sum"}).count()
    assert sum(n for n, _ in got.values()) == want and sum(x for _, x in got.values()) == 4950 and len(got) == 34
