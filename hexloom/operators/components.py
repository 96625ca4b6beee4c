"""Connected components of an edge table, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.sources.shared import dropped, scratch, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for each id in ``edges``; a component is named by its smallest id.

    Each round is two joins and an aggregate on ids, written to the shared folder; edges within a component go, and the
    others are contracted to the components found so far, so rounds get smaller and a vertex with many edges meets them
    once. Only whether edges are left is asked of the driver.
    """
    with scratch():
        return written(_components(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "components", keep=True)


def _components(edges: DataFrame) -> DataFrame:
    left = written(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    ends = lambda e: e.select("u").unionByName(e.select(F.col("v").alias("u"))).distinct()
    label = written(ends(left).select(F.col("u").alias("id"), F.col("u").alias("component")), "labels")
    while not left.isEmpty():
        # every vertex looks to its smallest neighbour, and on from there until that is its own smallest
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("r")), "hooks")
        while True:
            far = to.select(F.col("u").alias("r"), F.col("r").alias("r2"))
            on = written(to.join(far, "r").select("u", F.col("r2").alias("r"), (F.col("r2") < F.col("r")).alias("moved")), "hooks")
            done = on.filter("moved").isEmpty()
            dropped(to)
            to = on
            if done:
                break
        to = to.select("u", "r")
        old, label = label, written(label.join(to.withColumnRenamed("u", "component"), "component", "left").select("id", F.coalesce("r", "component").alias("component")), "labels")
        dropped(old)
        near = left.join(to, "u").select(F.col("r").alias("u"), "v").join(to.select(F.col("u").alias("v"), F.col("r").alias("s")), "v").select("u", F.col("s").alias("v"))
        old, left = left, written(near.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
        dropped(old)
    return label
