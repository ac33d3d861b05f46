"""Connected components of an edge table, by contraction in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import settle


def connected_components(edges: DataFrame, name: str = "graph") -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (src, dst) is linked with. Self-links count as nodes."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    live = settle(edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), name)
    labels = settle(nodes.withColumn("component", F.col("node")), name)
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        goes = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), name)
        labels = settle(labels.join(goes.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), name)
        p, q = goes.select("a", F.col("to").alias("p")), goes.select(F.col("a").alias("b"), F.col("to").alias("q"))
        live = settle(live.join(p, "a").join(q, "b").filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), name)
    return labels


def numbered(values: DataFrame, column: str, number: str, name: str = "numbered") -> DataFrame:
    """(column, number): distinct values of ``column`` (nulls left out) numbered from 0 in order. Ranges are numbered side by
    side and offset by the counts of the ranges before, one row for each range, so no task sees all values."""
    own = values.filter(F.col(column).isNotNull()).select(column).distinct()
    dealt = settle(own.repartitionByRange(column).withColumn("__range", F.spark_partition_id()), name)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    start = dealt.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(column)) - 1
    return dealt.withColumn("__place", place).join(start, "__range").select(column, (F.col("__place") + F.col("__start")).cast("long").alias(number))
