"""Pixel grids of decoded images, and perceptual hashes by the cosine transform."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Share of blue, green and red in a gray value. Fixed values.
GRAY = (0.114, 0.587, 0.299)
#: The same in units of 2^-16, as image libraries round it; lobes of the resampling and units of its weights. Fixed values.
GRAY_UNITS, LOBES, UNITS = (7471, 38470, 19595), 3, 1 << 22


def cosine_basis(side: int) -> np.ndarray:
    """The orthonormal DCT-II matrix: a row for each frequency."""
    k, i = np.mgrid[:side, :side]
    basis = np.sqrt(2 / side) * np.cos(np.pi * (2 * i + 1) * k / (2 * side))
    basis[0] = np.sqrt(1 / side)
    return basis


def low_frequencies(grids: np.ndarray, side: int) -> np.ndarray:
    """The side x side lowest coefficients of each square grid, in rows; what is tiny beside a grid's largest is 0."""
    basis = cosine_basis(grids.shape[1])[:side]
    low = (basis @ grids @ basis.T).reshape(len(grids), -1)
    return np.where(np.abs(low) < 1e-12 * np.abs(low).max(1, keepdims=True), 0.0, low)


def dct_hash(rows: DataFrame, pixels: int) -> DataFrame:
    """(id, h) of ``rows`` (id, v), v a gray grid of pixels x pixels: bit i of h says that low coefficient i (8 x 8, row by
    row) is over the median of all but the first. Null grids have a null hash."""

    def run(batches):
        for b in batches:
            v = b.column("v")
            there = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            h = np.zeros(b.num_rows, np.int64)
            if len(there):
                grids = v.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, pixels, pixels)
                low = low_frequencies(grids, 8)
                bits = low > np.median(low[:, 1:], axis=1)[:, None]
                h[there] = np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0]
            mask = np.ones(b.num_rows, bool)
            mask[there] = False
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(h, mask=mask)], ["id", "h"])

    return rows.select("id", "v").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, h long")


@functools.lru_cache(256)
def resampling(n: int, pixels: int) -> np.ndarray:
    """Weights (pixels, n) that take n values to ``pixels``: a three-lobed windowed sinc, widened where values are merged, in units of 2^-22."""
    wide = max(n / pixels, 1.0)
    centre = (np.arange(pixels)[:, None] + 0.5) * (n / pixels)
    x = (np.arange(n)[None] + 0.5 - centre) / wide
    w = np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)
    w /= w.sum(1, keepdims=True)
    return np.sign(w) * np.floor(np.abs(w) * UNITS + 0.5)


def resized(gray: np.ndarray, pixels: int) -> np.ndarray:
    """A gray image of bytes as pixels x pixels bytes: rows are resampled first, then columns, each rounded to bytes. Sums stay exact in doubles."""
    out = gray.astype(np.float64)
    for _ in range(2):
        out = np.clip(np.floor((out @ resampling(out.shape[1], pixels).T + UNITS // 2) / UNITS), 0, 255).T
    return out


def gray_bytes(raw: np.ndarray) -> np.ndarray:
    """Gray values of an image (height, width, channels) whose first three channels are blue, green and red."""
    if raw.shape[2] == 1:
        return raw[:, :, 0]
    return ((raw[:, :, :3].astype(np.int64) @ np.array(GRAY_UNITS) + 0x8000) >> 16).astype(np.uint8)


def gray_grids(images: DataFrame, pixels: int) -> DataFrame:
    """(path, v) of rows of Spark's image source (path, image): gray bytes, resampled to a pixels x pixels grid without aliases.
    An image without pixels has a null grid."""

    def run(batches):
        for b in batches:
            out = []
            for height, width, channels, data in zip(*(b.column(c).to_pylist() for c in ("height", "width", "nChannels", "data"))):
                some = height and width and height > 0 and width > 0
                out.append(resized(gray_bytes(np.frombuffer(data, np.uint8).reshape(height, width, channels)), pixels).reshape(-1).tolist() if some else None)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(out, pa.list_(pa.float64()))], ["path", "v"])

    parts = images.select("path", "image.height", "image.width", "image.nChannels", "image.data")
    return parts.mapInArrow(run, "path string, v array<double>")


def hue_saturation_value(rgb: np.ndarray) -> np.ndarray:
    """Bytes of hue, saturation and value of RGB bytes (..., 3), each over the whole byte range, rounded down."""
    c = rgb.astype(np.float32)
    high, low = c.max(-1), c.min(-1)
    span = high - low
    some = np.where(span > 0, span, 1).astype(np.float32)
    r, g, b = ((high - c[..., i]) / some for i in range(3))
    turn = np.where(c[..., 0] == high, b - g, np.where(c[..., 1] == high, 2 + r - b, 4 + g - r))
    hue = np.where(span > 0, np.mod(turn / 6 + 1, 1), 0)
    saturation = np.where(span > 0, span / np.where(high > 0, high, 1), 0)
    return np.stack([(hue * 255).astype(np.uint8), (saturation * 255).astype(np.uint8), high.astype(np.uint8)], -1)


def texture_codes(gray: np.ndarray, points: int, radius: float) -> np.ndarray:
    """Uniform local binary patterns of a gray image: how many of ``points`` neighbours on a circle are at least as bright, or
    points + 1 where they change sides more than twice. Neighbours are interpolated; outside the image they are 0."""
    height, width = gray.shape
    pad = int(np.ceil(radius)) + 1
    wide = np.pad(gray.astype(np.float64), pad)
    over = np.empty((points, height, width), bool)
    for k in range(points):
        y, x = (round(v, 5) for v in (-radius * np.sin(2 * np.pi * k / points), radius * np.cos(2 * np.pi * k / points)))
        top, left = int(np.floor(y)), int(np.floor(x))
        fy, fx = y - top, x - left
        at = lambda i, j: wide[pad + top + i : pad + top + i + height, pad + left + j : pad + left + j + width]
        seen = (1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1))
        over[k] = seen - gray >= -1e-9
    changes = (over != np.roll(over, 1, 0)).sum(0) - (over[0] != over[-1])  # from first to last, not round the circle
    return np.where(changes <= 2, over.sum(0), points + 1)


def pixel_histograms(images: DataFrame, points: int = 24, radius: float = 8) -> DataFrame:
    """(path, v) of rows of Spark's image source (path, image): counts of hue, saturation, value and gray over 256 bins each,
    then the shares of the points + 2 texture codes and zeros up to points + 4. One image is in memory at a time."""

    def run(batches):
        for b in batches:
            out = []
            for height, width, channels, data in zip(*(b.column(c).to_pylist() for c in ("height", "width", "nChannels", "data"))):
                raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                rgb = np.repeat(raw, 3, 2) if channels == 1 else raw[:, :, 2::-1]  # the source stores blue first
                gray = np.round(rgb.astype(np.float64) @ np.array(GRAY[::-1])).astype(np.uint8)
                parts = [*np.moveaxis(hue_saturation_value(rgb), -1, 0), gray]
                counts = [np.bincount(p.reshape(-1), minlength=256).astype(np.float64) for p in parts]
                texture = np.bincount(texture_codes(gray, points, radius).reshape(-1), minlength=points + 4)
                out.append(np.concatenate([*counts, texture / max(1, height * width)]))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([x.tolist() for x in out], pa.list_(pa.float64()))], ["path", "v"])

    parts = images.select("path", "image.height", "image.width", "image.nChannels", "image.data")
    return parts.mapInArrow(run, "path string, v array<double>")


def embedded(rows: DataFrame, models: dict, batch: int = 64) -> DataFrame:
    """(id, one array<double> column for each model) of rows (id, content): every content is handed to all models in one pass.

    models: name and a callable that takes a list of contents and returns a list of vectors, None for what it can't read;
    rows that any model can't read are left out, null contents too. A callable is loaded once in a worker.
    """
    names = list(models)

    def run(batches):
        for b in batches:
            ids, contents = b.column("id").to_pylist(), b.column("content").to_pylist()
            there = [i for i, c in enumerate(contents) if c is not None]
            for k in range(0, len(there), batch):
                some = there[k : k + batch]
                vectors = [models[n]([contents[i] for i in some]) for n in names]
                read = [j for j in range(len(some)) if all(v[j] is not None for v in vectors)]
                columns = [pa.array([[float(x) for x in v[j]] for j in read], pa.list_(pa.float64())) for v in vectors]
                yield pa.RecordBatch.from_arrays([pa.array([ids[some[j]] for j in read], b.schema.field("id").type), *columns], ["id", *names])

    schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *(f"`{n}` array<double>" for n in names)])
    return rows.select("id", "content").mapInArrow(run, schema)
