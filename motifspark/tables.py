"""Tables in the shared folder: where iterative operators cut their lineage."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="motifspark-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A place under spark.checkpoint.dir; where that is unset, in a folder of our own in a single process, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:  # a running session does not let this setting be changed
        if not re.match(r"local(\[[^,\]]*[,\d]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under spark.checkpoint.dir and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
