"""Connected components by contraction, in joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges (u, v) of longs -> (v, label): every vertex with the smallest vertex that it can reach.

    Each round maps every vertex to its smallest neighbour (or itself) and contracts the graph along these maps, so the edges
    left shrink fast and a hub only takes part in minima and in joins whose large keys Spark may split. The maps are then
    composed. Every round is written to the shared folder: no lineage grows and no vertex list reaches the driver.
    """
    e = scratch.put(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-e0")
    label, k = None, 0
    while label is None or not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = scratch.put(both.groupBy("u").agg(F.least("u", F.min("v")).alias("to")), f"{name}-m{k}")
        jump = step.alias("a").join(step.select(F.col("u").alias("to"), F.col("to").alias("far")), "to").select(F.col("a.u").alias("u"), F.col("far").alias("to"))
        step = scratch.put(jump, f"{name}-j{k}")
        left = e.join(step.withColumnRenamed("to", "x"), "u").select("v", "x")
        new = left.join(step.select(F.col("u").alias("v"), F.col("to").alias("y")), "v").filter("x <> y")
        new = scratch.put(new.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), f"{name}-e{k + 1}")
        if label is None:
            label = step.select(F.col("u").alias("v"), F.col("to").alias("label"))
        else:
            label = label.join(step.select(F.col("u").alias("label"), "to"), "label", "left").select("v", F.coalesce("to", "label").alias("label"))
        label = scratch.put(label, f"{name}-l{k}")
        scratch.drop(f"{name}-e{k}", f"{name}-m{k}", f"{name}-j{k}", *([f"{name}-l{k - 1}"] if k else []))
        e, k = new, k + 1
    return label
