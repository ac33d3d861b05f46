"""Connected components of an edge table by contraction.

Each round sends every node to the least node of its neighbourhood, and edges between what remains go on.
Rounds shrink the edges geometrically, are written to the shared folder, and never reach the driver, which
sees one count a round. A hub is no problem: neighbourhoods are aggregated partially, and the joins are
between edges and one row for each node, which adaptive execution splits where a node is frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the least node that it is linked with, itself included.

    Self-links, repeated links and either direction are fine; rows with a null end are left out. No edges: no rows.
    """
    pairs = edges.filter("a is not null and b is not null")
    live = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0")
    labels: DataFrame | None = None
    round_ = 0
    while True:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        goes = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), f"{name}-goes{round_}")
        # a node's goal may itself go on: one hop more, so chains of stars close faster
        hop = goes.alias("x").join(goes.alias("y"), F.col("x.to") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.to").alias("to"))
        hop = stage(hop, f"{name}-hop{round_}")
        if labels is None:
            labels = hop.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            moved = labels.join(hop, labels["component"] == hop["a"], "left")
            labels = stage(moved.select("node", F.coalesce("to", "component").alias("component")), f"{name}-labels{round_}")
        left = live.join(hop.select("a", F.col("to").alias("p")), "a").join(hop.select(F.col("a").alias("b"), F.col("to").alias("q")), "b")
        live = stage(left.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), f"{name}-{round_ + 1}")
        round_ += 1
        if live.isEmpty():
            return labels
