"""Arriving hashes assigned to the nearest of a set of clusters, each id once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cluster import open_predictions
from ..operators.hashjoin import nearest_hash
from ..schema import TEMPLATE_FREE
from ..tables import settle, shared_path


def drain(spark: SparkSession, folder: str, shape: Callable[[DataFrame], DataFrame], time: str, medoids: DataFrame, names: DataFrame, late: str = "1 day", files: str = "*.parquet", base: str | None = None, reject: str = TEMPLATE_FREE, most_files: int = 1000) -> dict[str, DataFrame]:
    """Assign all that has arrived in ``folder`` since the last call with the same ``base``; folder may be a pattern, which fits
    a folder of files or a single file.

    shape makes (id, h, ``time``) of the files' rows. medoids: (cluster_id, h); names: (cluster_id, template). An id is
    assigned once: repeats are dropped by a state keyed by id that holds an id until the watermark, ``late`` behind the latest
    time seen, has passed it. Rows that come later than the watermark are not assigned, nor are
    rows whose time is null, or not after 1970, where watermarks begin. A null hash
    has a null cluster and is rejected. A batch writes its own folder, again the same one if it is repeated, so a restart
    loses and doubles nothing. base: progress and results, a fresh folder if not given. Returns predictions (id, time,
    cluster_id, dist, pred_label), counters (batch, n, rejected) and late (id), the ids that arrived without being assigned.
    """
    read = spark.read.option("pathGlobFilter", files)
    schema = read.parquet(folder).schema
    base = base or shared_path(spark, f"assign-{uuid.uuid4().hex}")
    medoids, names = settle(medoids, "assign-medoids"), settle(names, "assign-names")

    def put(batch: DataFrame, number: int) -> None:
        rows = settle(batch, "assign-batch")  # a batch is read twice, its state must move once
        near = rows.select("id", F.col(time)).join(nearest_hash(rows.select("id", "h"), medoids), "id")
        open_predictions(near, names, reject).select("id", time, "cluster_id", "dist", "pred_label").write.mode("overwrite").parquet(f"{base}/assigned/batch={number}")

    arriving = shape(spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", most_files).parquet(folder))
    once = arriving.withWatermark(time, late).dropDuplicatesWithinWatermark(["id"])
    run = once.writeStream.option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    own = medoids.schema
    out = spark.read.schema(f"id {shape(read.parquet(folder)).schema['id'].dataType.simpleString()}, {time} timestamp, cluster_id {own['cluster_id'].dataType.simpleString()}, dist int, pred_label string, batch int").parquet(f"{base}/assigned")
    counters = out.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(F.col("pred_label") == reject).alias("rejected"))
    missed = shape(read.parquet(folder)).select("id").distinct().join(out.select("id"), "id", "left_anti")
    return {"predictions": out.drop("batch"), "counters": counters, "late": missed}
