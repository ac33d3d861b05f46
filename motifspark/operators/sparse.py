"""Sparse-representation matching with a dictionary that no task holds whole.

A query y is coded as the x that minimises |y - x A|^2 / 2 + l |x|_1 over the atoms (rows) of A. Blocks of queries keep a
working set of atoms, for which the code is solved. The dictionary is divided into parts; each part is priced against
the residuals of each block: an atom outside the working set belongs into it if its product with a residual is over l.
When there is none, the codes satisfy the optimality conditions of the whole dictionary, so they are its codes.

Parts are screened: the residual, scaled to be feasible, is a point of the dual problem, and the duality gap bounds how
far the dual optimum is from it. If by that bound no atom of a part can be active for any query of a block, the
part's atoms have zero weight in the optimum, and the pair is not priced again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import settle
from .densejoin import _matrix

#: Numbers in a part of the dictionary or in a block of queries, about.
PART_NUMBERS = 4 << 20
#: Atoms that a part offers for a query in a round at most; the rest is priced again in the next round.
OFFERS = 8
_STATE = "b long, id long, v array<double>, code array<struct<ref:long,x:double>>, r array<double>, rr double, ry double, l1 double, yy double, label string, residual double"
_CODE = pa.list_(pa.struct([("ref", pa.int64()), ("x", pa.float64())]))


def sparse_code(gram: np.ndarray, pull: np.ndarray, level: float, x: np.ndarray) -> np.ndarray:
    """The x that minimises x G x / 2 - pull x + level * |x|_1, from a start, by steps on signs that end at an optimum.

    With given signs the minimum is a linear solution. While its signs differ, the step stops at the best place where a
    coordinate becomes zero and that one leaves; when they agree, the zero coordinate that pulls hardest joins.
    """
    x = x.copy()
    signs = np.sign(x)
    for _ in range(50 * len(x) + 50):
        slope = pull - gram @ x
        on = np.flatnonzero(signs)
        settled = np.allclose(slope[on], level * signs[on], rtol=0, atol=1e-9 * level)
        if settled:
            away = np.where(signs == 0, np.abs(slope), 0)
            j = int(away.argmax())
            if not away[j] > level * (1 + 1e-9):
                return x
            signs[j] = np.sign(slope[j])
            on = np.flatnonzero(signs)
        g, rhs = gram[np.ix_(on, on)], pull[on] - level * signs[on]
        goal = np.linalg.lstsq(g, rhs, rcond=1e-12)[0]
        now, miss = x[on], rhs - g @ goal
        if np.abs(miss).max() > 1e-9 * level:  # dependent atoms: along this way nothing but the sum of sizes changes, it falls
            back = (miss * now < 0) & (np.abs(miss) > 1e-9 * level)
            first = np.where(back, -now / np.where(back, miss, 1), np.inf)
            x[on] = np.where(np.arange(len(on)) == first.argmin(), 0, now + first.min() * miss)
            signs = np.sign(x)
            continue
        if (np.sign(goal) == signs[on]).all():
            x[on] = goal
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = now / (now - goal)
        stops = np.append(np.unique(cross[(cross > 0) & (cross < 1)]), 1.0)
        points = now + stops[:, None] * (goal - now)
        points[np.abs(points) < 1e-14 * np.abs(goal).max()] = 0
        cost = 0.5 * np.einsum("pi,ij,pj->p", points, g, points) - points @ pull[on] + level * np.abs(points).sum(1)
        x[on] = points[int(cost.argmin())]
        signs = np.sign(x)
    return _descend(gram, pull, level, x)


def _descend(gram: np.ndarray, pull: np.ndarray, level: float, x: np.ndarray, sweeps: int = 20_000) -> np.ndarray:
    """Coordinate descent, for atoms so nearly dependent that signs go round in a circle."""
    norms, live = gram.diagonal(), np.flatnonzero(gram.diagonal() > 0)
    slope = pull - gram @ x
    for _ in range(sweeps):
        moved = 0.0
        for j in live:
            own = slope[j] + x[j] * norms[j]
            step = np.sign(own) * max(abs(own) - level, 0) / norms[j] - x[j]
            if step:
                x[j] += step
                slope -= step * gram[j]
                moved = max(moved, abs(step) * norms[j] ** 0.5)
        if moved < 1e-9:
            break
    return x


def sparse_codes(atoms: np.ndarray, targets: np.ndarray, level: float, start: np.ndarray | None = None) -> np.ndarray:
    """Rows of coefficients that minimise |y - x A|^2 / 2 + level * |x|_1 for each target y."""
    gram, pull = atoms @ atoms.T, targets @ atoms.T
    start = np.zeros(pull.shape) if start is None else start
    return np.array([sparse_code(gram, p, level, x) for p, x in zip(pull, start)]).reshape(pull.shape)


def _coded(level: float, heads: list[str]):
    """Codes of a block over its working set, residuals, and the class that explains each query best."""

    def run(key, queries: pa.Table, work: pa.Table) -> pa.Table:
        if not queries.num_rows:
            return pa.table([pa.array([], t) for t in _KINDS], names=_NAMES)
        y = _matrix(queries, "v")
        work = work.sort_by([("label", "ascending"), ("ref", "ascending")])
        refs, names = work.column("ref").to_pylist(), np.array(work.column("label").to_pylist(), object)
        atoms = _matrix(work, "w") if refs else np.zeros((0, y.shape[1]))
        at = {r: k for k, r in enumerate(refs)}
        start = np.zeros((len(y), len(refs)))
        for i, code in enumerate(queries.column("code").to_pylist()):
            for c in code:
                start[i, at[c["ref"]]] = c["x"]
        x = sparse_codes(atoms, y, level, start)
        rest = y - x @ atoms
        codes, labels, left = [], [], []
        for i in range(len(y)):
            own = np.flatnonzero(x[i])
            codes.append([{"ref": refs[j], "x": float(x[i, j])} for j in own])
            best = {}
            for name in sorted(set(names[own])):
                mine = own[names[own] == name]
                best[name] = float(np.linalg.norm(y[i] - x[i, mine] @ atoms[mine]))
            zero = next((h for h in heads if h not in best), None)  # classes without a part leave all of y
            if zero is not None:
                best[zero] = float(np.linalg.norm(y[i]))
            name = min(best, key=lambda k: (best[k], k))
            labels.append(name)
            left.append(best[name])
        sums = [(rest * rest).sum(1), (rest * y).sum(1), np.abs(x).sum(1), (y * y).sum(1)]
        lists = [list(z) for z in rest]
        cols = [queries.column("b"), queries.column("id"), queries.column("v"), pa.array(codes, _CODE), pa.array(lists, pa.list_(pa.float64())), *(pa.array(s) for s in sums), pa.array(labels, pa.string()), pa.array(left)]
        return pa.table(cols, names=_NAMES)

    return run


_NAMES = ["b", "id", "v", "code", "r", "rr", "ry", "l1", "yy", "label", "residual"]
_KINDS = [pa.int64(), pa.int64(), pa.list_(pa.float64()), _CODE, pa.list_(pa.float64()), *[pa.float64()] * 4, pa.string(), pa.float64()]


def _priced(level: float):
    """For each query of a block and a part: the largest product of an atom with its residual, the largest norm, and atoms to add."""

    def run(key, queries: pa.Table, part: pa.Table) -> pa.Table:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
        names = ["b", "part", "id", "m", "norm", "adds"]
        if not queries.num_rows or not part.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        refs, atoms = part.column("ref").to_numpy(), _matrix(part, "w")
        pull = np.abs(_matrix(queries, "r") @ atoms.T)
        adds = []
        for i in range(len(pull)):
            over = np.flatnonzero(pull[i] > level * (1 + 1e-7))
            adds.append(refs[over[np.argsort(-pull[i, over], kind="stable")[:OFFERS]]].tolist())
        n = len(pull)
        cols = [queries.column("b"), pa.array([key[1].as_py()] * n, kinds[1]), queries.column("id"), pa.array(pull.max(1)), pa.array(np.full(n, np.sqrt((atoms * atoms).sum(1).max()))), pa.array(adds, kinds[5])]
        return pa.table(cols, names=names)

    return run


def _sound(v: str, size: int):
    return F.coalesce((F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def sparse_match(queries: DataFrame, references: DataFrame, alpha: float = 0.35, part: int | None = None, block: int = 256, counts: list | None = None) -> DataFrame:
    """(id, label, residual): the class whose part of each query's (id, v) sparse code over ``references`` (id, label, v) leaves
    the smallest residual, ties to the first label; codes minimise |y - x A|^2 / (2 dimensions) + alpha |x|_1.

    part: atoms in a part of the dictionary, by default so many that a part is about 32 MB. Of equal reference vectors the
    first label's counts. References that are null or have null or non-finite components, or another length than the longest
    sound vector's, take no part; such queries get null label and residual, as all do where there are no references. A repeated
    id is answered once for each row. ``counts``, if given, takes for each round the pairs of block and part that were priced.
    """
    spark = queries.sparkSession
    plain = references.select("label", F.col("v").cast("array<double>").alias("v")).filter("v is not null and label is not null")
    size = plain.agg(F.max(F.size("v"))).first()[0] or 0
    own = plain.filter(_sound("v", size)).groupBy("v").agg(F.min("label").alias("label"))
    atoms = settle(own.select(F.xxhash64("label", "v").alias("ref"), "label", F.col("v").alias("w")), "sparse-atoms")
    total = atoms.count()
    named = queries.select("id", F.col("v").cast("array<double>").alias("v")).withColumn("ok", _sound("v", size))
    unknown = named.filter("not ok" if total else "true").select("id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("residual"))
    asked = named.filter("ok")
    n = asked.count()
    if not total or not n:
        return unknown
    level = alpha * size
    parts = max(1, -(-total // (part or max(64, PART_NUMBERS // size))))
    blocks = max(1, -(-n // block))
    atoms = settle(atoms.withColumn("part", F.pmod(F.xxhash64("ref", F.lit(1)), F.lit(parts)).cast("long")), "sparse-parts")
    # the first label without a part of a code is among these, as a code has no more atoms than dimensions at the optimum
    heads = [r["label"] for r in atoms.select("label").distinct().orderBy("label").limit(size + 1).collect()]
    square = F.aggregate("v", F.lit(0.0), lambda a, z: a + z * z)
    zero = F.lit(0.0)
    state = asked.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("long").alias("b"), "id", "v", F.array().cast("array<struct<ref:long,x:double>>").alias("code"), F.col("v").alias("r"), square.alias("rr"), square.alias("ry"), zero.alias("l1"), square.alias("yy"), F.lit(heads[0]).alias("label"), F.sqrt(square).alias("residual"))
    state = settle(state, "sparse-state")
    alive = settle(spark.range(blocks).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part")), "sparse-pairs")
    work = settle(alive.limit(0).select("b", F.col("part").alias("ref")), "sparse-work")
    while True:
        if counts is not None:
            counts.append(alive.count())
        left = state.select("b", "id", "r").join(alive, "b")
        right = atoms.select("part", "ref", "w").join(alive, "part")
        priced = left.groupBy("b", "part").cogroup(right.groupBy("b", "part")).applyInArrow(_priced(level), "b long, part long, id long, m double, norm double, adds array<long>")
        priced = settle(priced, "sparse-prices")
        offered = priced.select("b", F.explode("adds").alias("ref")).distinct()
        new = settle(offered.join(work, ["b", "ref"], "left_anti"), "sparse-offers")
        if new.isEmpty():
            break
        # scaled residual, duality gap, and from it the radius in which the dual optimum lies
        scale = F.greatest(F.lit(level), F.col("top"))
        dual = level * F.col("ry") / scale - level * level * F.col("rr") / (2 * scale * scale)
        gap = F.greatest(0.5 * F.col("rr") + level * F.col("l1") - dual, F.lit(0.0)) + 1e-9 * F.col("yy")
        tops = priced.groupBy("b", "id").agg(F.max("m").alias("top")).join(state.select("b", "id", "rr", "ry", "l1", "yy"), ["b", "id"])
        reach = priced.join(tops.select("b", "id", scale.alias("scale"), (F.sqrt(2 * gap) / level).alias("radius")), ["b", "id"])
        alive = settle(reach.filter("m / scale + radius * norm >= 1").select("b", "part").distinct(), "sparse-pairs")
        work = settle(work.unionByName(new), "sparse-work")
        held = work.join(atoms.select("ref", "label", "w"), "ref")
        state = settle(state.select("b", "id", "v", "code").groupBy("b").cogroup(held.groupBy("b")).applyInArrow(_coded(level, heads), _STATE), "sparse-state")
    return state.select("id", "label", "residual").unionByName(unknown)
