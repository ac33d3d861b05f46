"""Running counts of arriving events by time window and kind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import shared_path


def window_counts(events: DataFrame, time: str, kind: str, value: str, width: str, late: str) -> DataFrame:
    """(start, kind, n, total) of a stream; a window's state goes once the watermark has passed it."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(kind).alias("kind"))
    return counted.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def drain(spark: SparkSession, folder: str, time: str, kind: str, value: str, width: str = "1 hour", late: str = "30 days", files: str = "*.parquet") -> DataFrame:
    """Counts of all that has arrived in ``folder`` (perhaps a pattern, which may fit a folder of files or a single file), in files named so: each batch writes the windows it changed, and the last word on each holds."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder).withColumn(time, F.col(time).cast("timestamp"))
    base = shared_path(spark, f"rates-{uuid.uuid4().hex}")

    def put(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/changed/part={batch}")

    run = window_counts(arriving, time, kind, value, width, late).writeStream.outputMode("update").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    changed = spark.read.parquet(f"{base}/changed")
    return changed.groupBy("start", "kind").agg(F.max_by(F.struct("n", "total"), "batch").alias("s")).select("start", "kind", "s.n", "s.total")
