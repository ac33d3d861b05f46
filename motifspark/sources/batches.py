"""Runs of many methods and seeds that can be taken up again: a manifest says which are done."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ENTRY = "method string, seed int, path string, rows long"


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """(method, seed, path, rows) of the runs under ``root`` that ended."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    there = files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)
    return spark.read.schema(_ENTRY).option("recursiveFileLookup", "true").parquet(f"{root}/manifest") if there else spark.createDataFrame([], _ENTRY)


def resume(spark: SparkSession, root: str, wanted: list[tuple[str, int]], run: Callable[[str, int], DataFrame]) -> DataFrame:
    """Rows of all ``wanted`` (method, seed) with method and seed; run(method, seed) is called for those not done yet.

    A run writes a folder of its own, and then one manifest row in place of any other of that method and seed; only folders
    that the manifest names are read. So a run that was cut off leaves rows that no one reads, and is run again; one that
    ended is never run again. Runs are a short list, their rows are tables.
    """
    done = {(r["method"], r["seed"]) for r in manifest(spark, root).select("method", "seed").collect()}  # a row for each run
    for method, seed in dict.fromkeys(wanted):
        if (method, seed) in done:
            continue
        path = f"{root}/rows/{method}/{seed}-{uuid.uuid4().hex}"
        run(method, seed).write.parquet(path)
        entry = spark.createDataFrame([(method, seed, path, spark.read.parquet(path).count())], _ENTRY)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/{method}-{seed}")
    out = None
    asked = set(wanted)
    for e in sorted(r for r in manifest(spark, root).collect() if (r["method"], r["seed"]) in asked):
        one = spark.read.parquet(e["path"]).withColumn("method", F.lit(e["method"])).withColumn("seed", F.lit(e["seed"]))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no runs wanted")
    return out
