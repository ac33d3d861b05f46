"""Paired bootstrap over prediction tables.

A replicate's draws come from an integer hash of (seed, replicate, draw), the same for every method, so
differences are paired and SQL can replay them. Draws become weights by counting; metrics come from weighted
contingency counts, aggregated partially, never from rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import settle
from . import draws
from .graph import numbered
from .metrics import marginals, scores_of

# Fixed value: Student's t, 2 degrees of freedom, 97.5 %.
T_2 = 4.302653


def draw_hash(rep: Column, draw: Column, seed: int) -> Column:
    """28 bits of the MD5 of seed, replicate and draw, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), rep.cast("string"), draw.cast("string"))), 1, 7), 16, 10).cast("long")


def positions(ids: DataFrame, id: str) -> DataFrame:
    """(id, pos): ids of evaluation rows numbered from 0 in order."""
    return numbered(ids, id, "pos", "positions")


def weights(ids: DataFrame, id: str, replicates: int, seed: int) -> DataFrame:
    """(rep, id, w): how often each id is drawn in each replicate; n draws with replacement."""
    at = positions(ids, id)
    n = at.count()
    draws = ids.sparkSession.range(replicates * n).select(F.floor(F.col("id") / n).alias("rep"), (F.col("id") % n).alias("draw"))
    return draws.groupBy("rep", F.pmod(draw_hash(F.col("rep"), F.col("draw"), seed), F.lit(n)).alias("pos")).agg(F.count("*").alias("w")).join(at, "pos").select("rep", id, "w")


def replicate_scores(rows: DataFrame, w: DataFrame, keys: list[str], id: str) -> DataFrame:
    """Scores of every replicate by keys; rows: (id, keys, truth, pred)."""
    counts = rows.join(w, id).groupBy("rep", *keys, "truth", "pred").agg(F.sum("w").alias("n"))
    return scores_of(marginals(counts, ["rep", *keys]), ["rep", *keys], digits=9)


def replicate_binary(rows: DataFrame, w: DataFrame, keys: list[str], id: str, positive: str) -> DataFrame:
    """(rep, keys, precision, recall, f1) of one class in every replicate; a ratio over nothing is 0. rows: (id, keys, truth, pred)."""
    t, p = F.col("truth") == positive, F.col("pred") == positive
    count = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0))
    sums = rows.join(w, id).groupBy("rep", *keys).agg(count(t & p).alias("tp"), count(~t & p).alias("fp"), count(t & ~p).alias("fn"))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 9)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("rep", *keys, share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def pooled_scores(rows: DataFrame, key: str, id: str, replicates: int, seed: int, span: int = 1 << 22, chunk: int = 1 << 16) -> DataFrame:
    """The scores that replicate_scores gives with weights, for many replicates. A task draws some replicates: it counts their
    draws by position and sums these counts over rows (key, truth, pred) by cell, one of the distinct rows. Neither draws nor
    counts of ids leave it, so what is shuffled grows with rows and cells, not with replicates x ids.

    A task holds the rows of at most ``span`` positions, packed by ``chunk`` (65,536 at most, a divisor of span); where there
    are more, it draws once for each such range. Rows go to eight tasks for each core, however small they are.
    """
    import numpy as np
    import pyarrow as pa

    at = positions(rows, id)
    n = at.count()
    spark = rows.sparkSession
    each = rows.select(id, F.struct(key, "truth", "pred").alias("row"))
    cells = settle(numbered(each, "row", "cell", "boot-cells"), "boot-cells")

    def pack(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=["chunk", "places", "cells"])
        c = t.column("chunk")[0].as_py()
        place, cell = (t.column("pos").to_numpy() - c * chunk).astype(np.uint16), t.column("cell").to_numpy().astype(np.int32)
        return pa.table([pa.array([c]), pa.array([place.tobytes()]), pa.array([cell.tobytes()])], names=["chunk", "places", "cells"])

    placed = each.join(at, id).join(cells, "row").select((F.col("pos") / chunk).cast("long").alias("chunk"), "pos", "cell")
    packed = placed.groupBy("chunk").applyInArrow(pack, "chunk long, places binary, cells binary")
    tasks = 8 * spark.sparkContext.defaultParallelism
    block = max(1, -(-replicates // tasks))
    dealt = packed.select("*", F.floor(F.col("chunk") * chunk / span).alias("range"), F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // block) - 1))).alias("block"))

    def draw(t: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if t.num_rows:
            first, low = t.column("block")[0].as_py() * block, t.column("range")[0].as_py() * span
            size = min(span, n - low)
            place = np.concatenate([np.frombuffer(p, np.uint16).astype(np.int64) + (c * chunk - low) for c, p in zip(t.column("chunk").to_pylist(), t.column("places").to_pylist())])
            cell = np.concatenate([np.frombuffer(c, np.int32) for c in t.column("cells").to_pylist()])
            for rep in range(first, min(first + block, replicates)):
                w = np.zeros(size, np.int64)
                for drawn in draws.positions(seed, rep, n):
                    own = drawn if size == n else drawn[(drawn >= low) & (drawn < low + size)] - low
                    w += np.bincount(own, minlength=size)
                sums = np.bincount(cell, w[place])  # whole numbers, exact in doubles
                j = np.flatnonzero(sums)
                out.append((np.full(len(j), rep), j, sums[j].astype(np.int64)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["rep", "cell", "n"])

    drawn = dealt.repartition(tasks, "range", "block").groupBy("range", "block").applyInArrow(draw, "rep long, cell long, n long")
    counts = drawn.join(cells, "cell").select("rep", "row.*", "n")
    return scores_of(marginals(counts, ["rep", key]), ["rep", key], digits=9)


def intervals(values: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, mean, lo, hi): mean and 2.5 and 97.5 percentiles over replicates, four digits."""
    long = values.unpivot(["rep", *keys], metrics, "metric", "value")
    p = lambda q: F.round(F.percentile("value", q), 4)
    return long.groupBy(*keys, "metric").agg(F.round(F.avg("value"), 4).alias("mean"), p(0.025).alias("lo"), p(0.975).alias("hi"))


def paired_differences(values: DataFrame, by: str, reference: str, metrics: list[str]) -> DataFrame:
    """Intervals of every method's metrics minus the reference method's, replicate by replicate."""
    base = values.filter(F.col(by) == reference).select("rep", *(F.col(m).alias(f"__{m}") for m in metrics))
    diff = values.filter(F.col(by) != reference).join(base, "rep").select("rep", by, *((F.col(m) - F.col(f"__{m}")).alias(m) for m in metrics))
    return intervals(diff, [by], metrics)


def two_stage_interval(values: DataFrame, keys: list[str], metric: str, replicates: int) -> DataFrame:
    """(keys, mean, lo, hi): grand mean +- T_2 * sqrt(between / seeds + within / (seeds * replicates)) of values (keys, seed, rep)."""
    seeds = values.groupBy(*keys, "seed").agg(F.avg(metric).alias("m"), F.var_samp(metric).alias("v"))
    out = seeds.groupBy(*keys).agg(F.avg("m").alias("mean"), F.var_samp("m").alias("vb"), F.avg("v").alias("vw"), F.count("*").alias("s"))
    half = F.lit(T_2) * F.sqrt(F.col("vb") / F.col("s") + F.col("vw") / (F.col("s") * replicates))
    return out.select(*keys, F.round("mean", 4).alias("mean"), F.round(F.col("mean") - half, 4).alias("lo"), F.round(F.col("mean") + half, 4).alias("hi"))


def multinomial_scores(rows: DataFrame, key: str, id: str, replicates: int, seed: int, bucket: int = 1 << 14, block: int = 64) -> DataFrame:
    """Scores (rep, key, ...) of every replicate, drawn as counts: a replicate gives each profile, the rows (key, truth, pred) that
    some ids have in common, a share of its n draws by one multinomial, so work is replicates x profiles, not replicates x ids.

    Profiles lie in buckets of about ``bucket``. A replicate's counts of whole buckets are drawn first, the same in every
    task, and inside a bucket given its count; that is the multinomial over all profiles, and no task holds them all.
    The driver holds one number a bucket. Draws depend on seed, replicate and bucket only, so a repeated task draws the
    same. Replicates are paired over keys. Null labels are a label. Without rows there are no scores.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    own = rows.groupBy(id).agg(F.array_sort(F.collect_list(F.struct(key, "truth", "pred"))).alias("profile"))  # a row for each method
    alike = settle(own.groupBy("profile").agg(F.min(id).alias("like"), F.count("*").alias("n")), "boot-alike")
    buckets = max(1, -(-alike.count() // bucket))
    placed = alike.withColumn("bucket", F.pmod(F.xxhash64("like"), F.lit(buckets)).cast("int"))
    totals = {r["bucket"]: r["n"] for r in placed.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # a number a bucket
    filled = sorted(totals)
    sizes = np.array([totals[b] for b in filled], dtype=np.int64)
    schema = rows.schema[key].dataType.simpleString()

    def draw(t: pa.Table) -> pa.Table:
        if not t.num_rows:
            return t.select(["rep", "key", "truth", "pred", "n"])
        p = t.to_pandas().sort_values("like", kind="stable").reset_index(drop=True)
        b, first, n = int(p["bucket"][0]), int(p["block"][0]) * block, p["n"].to_numpy()
        reps = np.arange(first, min(first + block, replicates))
        counts = np.empty((len(reps), len(p)), dtype=np.int64)
        for i, rep in enumerate(reps):
            mine = np.random.default_rng([seed, rep]).multinomial(sizes.sum(), sizes / sizes.sum())[filled.index(b)]
            counts[i] = np.random.default_rng([seed, rep, b + 1]).multinomial(mine, n / n.sum())
        at = np.repeat(np.arange(len(p)), p["profile"].map(len))
        cells = pd.DataFrame([(e[key], e["truth"], e["pred"]) for profile in p["profile"] for e in profile], columns=["key", "truth", "pred"])
        code = cells.groupby(["key", "truth", "pred"], dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
        sums = np.add.reduceat(counts[:, at[order]], starts, axis=1)
        i, j = np.nonzero(sums)
        named = cells.iloc[order[starts]].reset_index(drop=True).iloc[j]
        return pa.table({"rep": pa.array(reps[i], pa.int64()), "key": pa.Array.from_pandas(named["key"], type=t.schema.field("profile").type.value_type.field(key).type), "truth": pa.Array.from_pandas(named["truth"], type=pa.string()), "pred": pa.Array.from_pandas(named["pred"], type=pa.string()), "n": pa.array(sums[i, j], pa.int64())})

    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // block) - 1))).alias("block")
    drawn = placed.select("bucket", "like", "n", "profile", blocks).groupBy("bucket", "block").applyInArrow(draw, f"rep long, key {schema}, truth string, pred string, n long")
    counts = drawn.groupBy("rep", F.col("key").alias(key), "truth", "pred").agg(F.sum("n").alias("n"))
    return scores_of(marginals(counts, ["rep", key]), ["rep", key], digits=9)
