"""Joins of dense vectors: radius by cosine distance, and nearest centroid."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import settle


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    c = table.column(name).combine_chunks()
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1)


def sound(v: str):
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _blocks(left: DataFrame, right: DataFrame, tile: int):
    n, m = max(1, -(-left.count() // tile)), max(1, -(-right.count() // tile))
    a = left.select(F.col("id").alias("id"), F.col("v").alias("v"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    b = right.select(F.col("id").alias("other"), F.col("v").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("oi"), F.pmod(F.xxhash64("id"), F.lit(m)).cast("int").alias("oj"))
    return a.groupBy("i", "j").cogroup(b.groupBy("oi", "oj"))


#: Most pivots of a radius join, and rows they are chosen from for each: 4096 vectors at most meet on the driver.
MOST_PIVOTS, SAMPLE = 512, 8


def _pivots(rows: DataFrame, n: int) -> np.ndarray:
    """At most n different vectors of ``rows``, each the farthest from those before it in a sample that is picked by hash."""
    found = rows.orderBy(F.xxhash64("id"), "id").limit(n * SAMPLE).select("v").toArrow()
    sample = _matrix(found, "v")
    chosen, apart = [0], _squares(sample, sample[:1])[:, 0]
    while len(chosen) < n and apart.max() > 1e-12:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, _squares(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of y; not below 0."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _celled(right: DataFrame, pivots: np.ndarray, width: float) -> DataFrame:
    """(id, v, cell, ring, far, sq): the nearest pivot, the distance to it and that in units of ``width``, the squared norm."""

    def run(batches):
        for b in batches:
            v = _matrix(pa.table([b.column("v")], names=["v"]), "v")
            d = _squares(v, pivots)
            cell = d.argmin(1) if len(v) else np.zeros(0, np.int64)
            far = np.sqrt(d[np.arange(len(v)), cell])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(np.minimum(far / width, 1 << 20).astype(np.int32)), pa.array(far), pa.array((v * v).sum(1))], ["id", "v", "cell", "ring", "far", "sq"])

    return right.mapInArrow(run, "id long, v array<double>, cell int, ring int, far double, sq double")


def _zones(celled: DataFrame, tile: int) -> list[dict]:
    """Neighbouring rings of a cell, joined until they hold half a tile: cell, first and last ring, least and most distance to
    the pivot, largest squared norm, rows. As many rows as there are rings of pivots; no more than two for each half tile are left."""
    rings = celled.groupBy("cell", "ring").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.max("sq").alias("sq"), F.count("*").alias("n"))
    zones: list[dict] = []
    for r in rings.orderBy("cell", "ring").toArrow().to_pylist():
        z = zones[-1] if zones else None
        if z and z["cell"] == r["cell"] and z["n"] < tile // 2:
            z |= {"last": r["ring"], "high": r["high"], "sq": max(z["sq"], r["sq"]), "n": z["n"] + r["n"]}
        else:
            zones.append({"cell": r["cell"], "first": r["ring"], "last": r["ring"], "low": r["low"], "high": r["high"], "sq": r["sq"], "n": r["n"]})
    return zones


def _routed(left: DataFrame, pivots: np.ndarray, zones: list[dict], radius: float) -> DataFrame:
    """(id, v, zones): the numbers of the zones that may hold a vector within the radius.

    1 - x.y <= radius says |x - y|^2 <= 2 radius - 2 + |x|^2 + |y|^2, which bounds by how much distances to the zone's pivot
    differ (its ring), and how far x is beyond the plane between that pivot and its own (the cell).
    """
    cell, low, high, sq = (np.array([z[k] for z in zones]) for k in ("cell", "low", "high", "sq"))
    between = 2 * np.sqrt(_squares(pivots, pivots))
    longest = np.sqrt(max((pivots * pivots).sum(1).max(), sq.max()))

    def some(v: np.ndarray) -> list[np.ndarray]:
        own = (v * v).sum(1)[:, None]
        slack = 1e-6 * (1 + np.sqrt(own) + longest)  # over the rounding of distances from products
        d = _squares(v, pivots)
        nearest = d.argmin(1)
        beyond = np.divide(d - d.min(1, keepdims=True), between[nearest], out=np.zeros_like(d), where=between[nearest] > 0)[:, cell]
        far, room = np.sqrt(d)[:, cell], 2 * radius - 2 + own + sq
        reach = np.sqrt(np.maximum(room, 0)) + slack
        may = (room >= -slack) & (far >= low - reach) & (far <= high + reach) & (beyond <= reach)
        return [np.flatnonzero(row).astype(np.int32) for row in may]

    def run(batches):
        for b in batches:
            v = _matrix(pa.table([b.column("v")], names=["v"]), "v")
            for at in range(0, len(v), 256):
                hit = some(v[at : at + 256])
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(h) for h in hit])]).astype(np.int32), np.concatenate(hit))
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), lists], ["id", "v", "zones"])

    return left.mapInArrow(run, "id long, v array<double>, zones array<int>")


def radius_zones(left: DataFrame, right: DataFrame, radius: float, tile: int = 1024) -> tuple[DataFrame, DataFrame, list[dict]] | None:
    """(left with the zones it may have to meet, right with cell and ring, the zones with n and asked, the rows of either side);
    nothing where a side is empty. The sum of n * asked is how many pairs ``cosine_radius_join`` compares."""
    held = right.filter(sound("v")).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    asked = left.filter(sound("v")).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    many = held.count()
    if not many:
        return None
    pivots = _pivots(held, min(MOST_PIVOTS, -(-many // tile)))
    celled = settle(_celled(held, pivots, max(math.sqrt(2 * max(radius, 0)), 0.0625)), "radius-cells")
    zones = _zones(celled, tile)
    routed = settle(_routed(asked, pivots, zones, radius), "radius-routes")
    met = {r["zone"]: r["n"] for r in routed.select(F.explode("zones").alias("zone")).groupBy("zone").agg(F.count("*").alias("n")).toArrow().to_pylist()}
    return routed, celled, [z | {"asked": met.get(i, 0)} for i, z in enumerate(zones)]


def cosine_radius_join(left: DataFrame, right: DataFrame, radius: float, tile: int = 1024) -> DataFrame:
    """(id, other, dist) of unit vectors (id, v) with 1 - dot <= radius; only hits leave a block.
    Vectors that are null or have null or non-finite components are near to none; all others must be of one length.

    The right side is dealt to pivots (512 at most) and rings around them; a left vector goes to the rings that triangle
    inequality and the planes between pivots leave, so near groups meet and far ones do not. Both sides of a zone are cut
    into tiles by hash, so a zone that holds a third of all rows is many tasks. Vectors of other norms give right results
    too. Where nothing can be left out, all tiles meet all tiles.
    """
    spark, schema = left.sparkSession, "id long, other long, dist double"
    plan = radius_zones(left, right, radius, tile)
    if not plan or not any(z["asked"] for z in plan[2]):
        return spark.createDataFrame([], schema)
    routed, celled, zones = plan
    cut = lambda n: -(-n // tile)
    numbers = [(i, z["cell"], z["first"], z["last"], cut(z["asked"]), cut(z["n"])) for i, z in enumerate(zones) if z["asked"]]
    known = F.broadcast(spark.createDataFrame(numbers, "zone int, cell int, first int, last int, lefts int, rights int"))  # numbers of zones, 24 bytes each
    across = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tile_of = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    a = routed.select("id", "v", F.explode("zones").alias("zone")).join(known.select("zone", "lefts", "rights"), "zone").select("id", "v", "zone", tile_of("lefts").alias("i"), across("rights").alias("j"))
    held = celled.join(known, (celled["cell"] == known["cell"]) & F.col("ring").between(F.col("first"), F.col("last")))
    b = held.select(F.col("id").alias("other"), F.col("v").alias("w"), F.col("zone").alias("oz"), tile_of("rights").alias("oj"), across("lefts").alias("oi"))

    def near(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["id", "other", "dist"])
        p, q = x.column("id").to_numpy(), y.column("other").to_numpy()
        d = 1 - _matrix(x, "v") @ _matrix(y, "w").T
        i, j = np.nonzero(d <= radius)
        return pa.table([pa.array(p[i]), pa.array(q[j]), pa.array(d[i, j])], names=["id", "other", "dist"])

    return a.groupBy("zone", "i", "j").cogroup(b.groupBy("oz", "oi", "oj")).applyInArrow(near, schema)


#: Bytes of vectors in a block of ``cosine_cells``, least rows of one, and into how many blocks the sides are cut while blocks are smaller.
BLOCK_BYTES, LEAST_BLOCK, CUTS = 32 << 20, 1024, (8, 6)


def cosine_cells(left: DataFrame, right: DataFrame, radii: list) -> DataFrame:
    """(id, label, bin, n, zero, inverse), as ``vote.cells`` of the edges of ``cosine_radius_join`` at the largest of ``radii``.

    left: (id, v); right: (other, v, label, copies). Blocks of the left meet blocks of the right and sum by label and radius
    where they meet, so edges never leave a task, and a vector is sent as often as the other side has blocks: 6 or 8 times
    up to some 400,000 and 500,000 rows of 64 dimensions, whatever the radius.
    """
    at = sorted(float(r) for r in radii)
    asked = left.filter(sound("v")).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    held = right.filter(sound("v")).select("other", F.col("v").cast("array<double>").alias("v"), "label", F.col("copies").cast("long").alias("copies"))
    some = right.filter(F.col("v").isNotNull()).select(F.size("v").alias("n")).first()
    block = max(LEAST_BLOCK, BLOCK_BYTES // (8 * max(1, some["n"] if some else 1)))
    cut = lambda rows, cuts: max(1, min(cuts, -(-rows // LEAST_BLOCK)), -(-rows // block))
    n, m = cut(left.select("id").count(), CUTS[0]), cut(right.select("other").count(), CUTS[1])
    a = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"))
    b = held.select("v", "label", "copies", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), F.pmod(F.xxhash64("other"), F.lit(m)).cast("int").alias("j"))
    wide = len(at)

    def summed(x: pa.Table, y: pa.Table) -> pa.Table:
        coded = y.column("label").combine_chunks().dictionary_encode(null_encoding="encode")
        code, many = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * wide, max(1, len(coded.dictionary)) * wide
        ids, copies = x.column("id").to_numpy(), y.column("copies").to_numpy().astype(np.float64)
        out = [(ids[:0], code[:0], np.zeros(0), np.zeros(0), np.zeros(0))]
        if len(ids) and len(code):
            v, w = _matrix(x, "v"), _matrix(y, "v")
            step = max(1, (1 << 21) // len(w))
            for k in range(0, len(v), step):
                d = 1 - v[k : k + step] @ w.T
                i, j = np.nonzero(d <= at[-1])
                far = d[i, j]
                cell = i * many + code[j] + np.searchsorted(at, far, "left")
                cells, cell = (np.arange(len(d) * many), cell) if many <= 4 * len(w) else np.unique(cell, return_inverse=True)
                none, own = far == 0, copies[j]
                count, zero, inverse = (np.bincount(cell, weight, len(cells)) for weight in (own, own * none, np.divide(own, far, out=np.zeros(len(far)), where=~none)))
                hit = np.flatnonzero(count)
                out.append((ids[k : k + step][cells[hit] // many], cells[hit] % many, count[hit], zero[hit], inverse[hit]))
        ids, cell, count, zero, inverse = (np.concatenate(c) for c in zip(*out))
        whole = [pa.array(c.astype(np.int64)) for c in (count, zero)]
        return pa.table([pa.array(ids), coded.dictionary.take(pa.array(cell // wide)), pa.array((cell % wide).astype(np.int32)), *whole, pa.array(inverse)], names=["id", "label", "bin", "n", "zero", "inverse"])

    shape = f"id long, label {right.schema['label'].dataType.simpleString()}, bin int, n long, zero long, inverse double"
    met = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(summed, shape)
    return met.groupBy("id", "label", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "zero", "inverse")))


def nearest_centroid(rows: DataFrame, centroids: DataFrame, tile: int = 8192) -> DataFrame:
    """(id, cluster_id, score): the centroid (cluster_id, v) with the largest dot product, ties to the smaller id.
    Null for vectors that are null or have null or non-finite components; such centroids take no part."""

    def best(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["id", "cluster_id", "score"])
        p, c = x.column("id").to_numpy(), y.column("other").to_numpy()
        order = np.argsort(c, kind="stable")
        s = _matrix(x, "v") @ _matrix(y, "w")[order].T
        at = s.argmax(1)
        return pa.table([pa.array(p), pa.array(c[order][at]), pa.array(s.max(1))], names=["id", "cluster_id", "score"])

    found = _blocks(rows.filter(sound("v")).select("id", "v"), centroids.filter(sound("v")).select(F.col("cluster_id").cast("long").alias("id"), "v"), tile).applyInArrow(best, "id long, cluster_id long, score double")
    best = found.groupBy("id").agg(F.max(F.struct("score", (-F.col("cluster_id")).alias("c"))).alias("s")).select("id", (-F.col("s.c")).alias("cluster_id"), "s.score")
    none = rows.filter(~sound("v")).select("id", F.lit(None).cast("long").alias("cluster_id"), F.lit(None).cast("double").alias("score"))
    return best.unionByName(none)
