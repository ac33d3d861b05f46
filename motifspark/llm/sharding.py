"""Sharding by extendible hashing, with DataFrame functions only.

A directory is indexed by the leading bits of a 32-bit key hash. Only buckets over the byte limit
split on one more bit. Weights are first summed per hash value (a partial aggregation: a hot key is
one row). The first levels work on a coarse table whose size follows the number of shards, not of
documents; only the few cells that are still too large there are looked at bit by bit down to 32.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BITS = 32
#: Rows of a bucket that no bit can split which one window numbers, as a power of two.
RUN_BITS = 16
COLUMNS = ["shard_depth", "shard_prefix", "shard_bytes", "shard_docs", "shard_part"]


def prefix_hash(key: Column) -> Column:
    """Leading 32 bits of the MD5 of a key's text, as a long (null key: the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def _levels(cells: DataFrame, limit: int, low: int, high: int) -> DataFrame:
    """Bucket sizes (depth, prefix, shard_bytes, shard_docs, open) for every depth from low to high of
    ``cells`` (lo, hi, n_bytes, n_docs); open: over the limit, and more than one hash value inside."""
    return (
        cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
        .groupBy("depth", F.expr(f"shiftright(lo, {BITS} - depth)").alias("prefix"))
        .agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .withColumn("open", (F.col("shard_bytes") > limit) & (F.col("lo") < F.col("hi")) & (F.col("depth") < BITS))
        .drop("lo", "hi")
    )


def _leaves(levels: DataFrame, low: int) -> DataFrame:
    """Buckets that are not open, though their parent is (at the lowest depth: any)."""
    parents = levels.filter("open").select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
    closed = levels.filter("not open").withColumn("parent", F.shiftright("prefix", 1))
    below = closed.filter(F.col("depth") > low).join(parents, ["depth", "parent"], "left_semi")
    return closed.filter(F.col("depth") == low).unionByName(below).drop("parent", "open")


def _parted(rows: DataFrame, limit: int, name: str) -> DataFrame:
    """``rows`` (__h, __b, ...) of buckets that no bit can split, with shard_part and the bytes and rows of that part.

    A row over half the limit is a part of its own. The others are laid end to end and cut every ``limit`` less the
    largest of them, each going where it begins, so no part is over the limit. Sums run in short windows, then over
    one row for each window, so neither a hot key nor copies of one row meet in one task.
    """
    at = F.monotonically_increasing_id()  # kept in the staged table, so the order is the same each time it is read
    rows = stage(rows.withColumn("__at", at), f"{name}-hot").withColumn("__run", F.shiftright("__at", RUN_BITS))
    large = F.col("__b") * 2 > limit
    rows = rows.withColumn("__large", large.cast("long")).withColumn("__small", F.when(large, 0).otherwise(F.col("__b")))
    runs = rows.groupBy("__h", "__run").agg(F.sum("__large").alias("l"), F.sum("__small").alias("s"), F.max("__small").alias("m"))
    before = Window.partitionBy("__h").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    upon = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    whole = runs.groupBy("__h").agg(F.sum("l").alias("n_large"), (F.lit(limit) - F.max("m")).alias("step"))
    runs = runs.select("__h", "__run", upon("l").alias("l0"), upon("s").alias("s0")).join(whole, "__h")
    here = Window.partitionBy("__h", "__run").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("__l", F.coalesce(F.sum("__large").over(here), F.lit(0))).withColumn("__s", F.coalesce(F.sum("__small").over(here), F.lit(0))).join(runs, ["__h", "__run"])
    part = F.when(F.col("__large") == 1, F.col("l0") + F.col("__l")).otherwise(F.col("n_large") + F.floor((F.col("s0") + F.col("__s")) / F.col("step")))
    own = stage(own.withColumn("shard_part", part.cast("int")).drop("__at", "__run", "__large", "__small", "__l", "__s", "l0", "s0", "n_large", "step"), f"{name}-parts")
    sums = own.groupBy("__h", "shard_part").agg(F.sum("__b").alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return own.drop("shard_bytes", "shard_docs").join(sums, ["__h", "shard_part"])


def shard(docs: DataFrame, key: str = "doc_id", size: Column | None = None, limit: int = 128 << 20, slack_bits: int = 5, name: str = "shards") -> DataFrame:
    """Rows of ``docs`` with shard_depth, shard_prefix, shard_bytes, shard_docs and shard_part.

    size: bytes of a row (by default the UTF-8 bytes of column ``text``; null or empty: 0). Null keys hash
    as the empty text; rows with equal keys share a bucket. What no bit can split (one hash value) is
    divided into shard_part 0, 1, ... by running bytes, so a hot key spreads too, copies of one row as well;
    shard_bytes and shard_docs are then the part's. Only a single row over the limit can stay over it. No rows
    in: no rows out. Columns of ``docs`` with the new names are replaced; other columns pass through.
    """
    size = F.coalesce(F.octet_length("text") if size is None else size, F.lit(0)).cast("long")
    rows = docs.drop(*COLUMNS).withColumn("__h", prefix_hash(F.col(key))).withColumn("__b", size)
    weights = stage(rows.groupBy(F.col("__h").alias("h")).agg(F.sum("__b").alias("n_bytes"), F.count("*").alias("n_docs")), f"{name}-weights")
    total = weights.agg(F.sum("n_bytes")).first()[0] or 0
    coarse = min(BITS - 1, max(0, math.ceil(math.log2(max(1, total / limit)))) + slack_bits)
    cell = F.shiftright("h", BITS - coarse)
    cells = weights.groupBy(cell.alias("c")).agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_docs").alias("n_docs"))
    levels = stage(_levels(cells, limit, 0, coarse), f"{name}-levels")
    still = levels.filter(f"open and depth = {coarse}").select(F.col("prefix").alias("c"))
    deep = weights.withColumn("c", cell).join(still, "c", "left_semi").select(F.col("h").alias("lo"), F.col("h").alias("hi"), "n_bytes", "n_docs")
    deep_levels = stage(_levels(deep, limit, coarse, BITS), f"{name}-deep")
    shallow = _leaves(levels, 0).withColumnsRenamed({"depth": "shard_depth", "prefix": "shard_prefix"})
    below = _leaves(deep_levels, coarse).withColumnsRenamed({"depth": "shard_depth", "prefix": "shard_prefix"})
    # a shallow leaf covers a range of coarse cells, a deep one is met by the hash values of its cell
    by_cell = shallow.withColumn("__c", F.explode(F.expr(f"sequence(shiftleft(shard_prefix, {coarse} - shard_depth), shiftleft(shard_prefix + 1, {coarse} - shard_depth) - 1)")))
    by_hash = deep.select(F.col("lo").alias("__h"), F.explode(F.sequence(F.lit(coarse), F.lit(BITS))).alias("shard_depth")).withColumn("shard_prefix", F.expr(f"shiftright(__h, {BITS} - shard_depth)")).join(below, ["shard_depth", "shard_prefix"])
    names = COLUMNS[:4]
    met = rows.withColumn("__c", F.shiftright("__h", BITS - coarse)).join(by_cell.select("__c", F.struct(*names).alias("__s")), "__c", "left").join(by_hash.select("__h", F.struct(*names).alias("__d")), "__h", "left")
    met = met.withColumn("__s", F.coalesce("__s", "__d"))
    met = met.select(*docs.drop(*COLUMNS).columns, *(F.col(f"__s.{c}").alias(c) for c in names), "__h", "__b")
    plain = [*docs.drop(*COLUMNS).columns, *COLUMNS]
    full = (F.col("shard_bytes") > limit) & (F.col("shard_docs") > 1)
    if shallow.unionByName(below).filter(full).isEmpty():
        return met.withColumn("shard_part", F.lit(0)).select(*plain)
    fits = met.filter(~full).withColumn("shard_part", F.lit(0))
    return fits.select(*plain).unionByName(_parted(met.filter(full), limit, name).select(*plain))
