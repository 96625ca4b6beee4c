"""Weighted directed graphs of cells as frames (edge, origin, destination, weight)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hexloom.functions import bits as B
from hexloom.functions import geo as X
from hexloom.kernel import shapes as S
from hexloom.operators.frame import flat_clusters
from hexloom.sources.shared import scratch, written

ORIGIN, DESTINATION, BOTH = 1, 2, 3
COLUMNS = ["edge", "origin", "destination", "weight"]


class MixedResolutions(ValueError):
    """Cells or edges of different resolutions where one is needed."""


def from_edges(df: DataFrame, edge: str = "edge", weight: str = "weight") -> DataFrame:
    """A graph from edges; of an edge that repeats the least weight counts, invalid edges go."""
    e = df.filter(B.is_valid_edge(edge)).groupBy(F.col(edge).alias("edge")).agg(F.min(weight).alias("weight"))
    return e.select("edge", B.raw_edge_origin("edge").alias("origin"), X.edge_destination("edge").alias("destination"), "weight")


def from_cells(df: DataFrame, origin: str, destination: str, weight: str, bidirectional: bool = False) -> DataFrame:
    """A graph from pairs of neighbouring cells."""
    pairs = df.select(F.col(origin).alias("a"), F.col(destination).alias("b"), F.col(weight).alias("weight"))
    if bidirectional:
        pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return from_edges(pairs.select(X.directed_edge("a", "b").alias("edge"), "weight"))


def from_links(df: DataFrame, edge: str, origin: str, destination: str, weight: str) -> DataFrame:
    """A graph from links that name their ends themselves; of links that repeat the least weight counts."""
    return df.groupBy(F.col(edge).alias("edge"), F.col(origin).alias("origin"), F.col(destination).alias("destination")).agg(F.min(weight).alias("weight")).select(*COLUMNS)


def try_add(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two graphs of one resolution."""
    res = {r["r"] for g in (a, b) for r in g.select(B.raw_resolution("edge").alias("r")).distinct().limit(2).collect()}
    if len(res) > 1:
        raise MixedResolutions(sorted(res))
    return a.unionByName(b).groupBy("edge", "origin", "destination").agg(F.min("weight").alias("weight"))


def nodes(graph: DataFrame) -> DataFrame:
    """(cell, node_type): 1 where edges begin, 2 where they end, 3 where both is so."""
    ends = graph.select(F.col("origin").alias("cell"), F.lit(ORIGIN).alias("t")).unionByName(graph.select(F.col("destination").alias("cell"), F.lit(DESTINATION).alias("t")))
    return ends.groupBy("cell").agg(F.bit_or("t").cast("tinyint").alias("node_type"))


def stats(graph: DataFrame) -> DataFrame:
    """One row: h3_resolution, num_nodes, num_edges."""
    n = nodes(graph).agg(F.count("*").alias("num_nodes"))
    e = graph.agg(F.max(B.raw_resolution("edge")).alias("h3_resolution"), F.count("*").alias("num_edges"))
    return e.crossJoin(n).select("h3_resolution", "num_nodes", "num_edges")  # one row each


def edge_weight(graph: DataFrame, edge: int) -> DataFrame:
    return graph.filter(F.col("edge") == edge).select("weight")


def edges_from(graph: DataFrame, cell: int) -> DataFrame:
    return graph.filter(F.col("origin") == cell)


def edges_to(graph: DataFrame, cell: int) -> DataFrame:
    """Edges that end in a cell."""
    return graph.filter(F.col("destination") == cell)


def exclude_cells(graph: DataFrame, cells: DataFrame, cell: str) -> DataFrame:
    """Without the edges that begin or end in one of ``cells``; long edges that touch one lose their shortcut."""
    gone = cells.select(F.col(cell).alias("_x")).distinct()
    out = graph.join(gone, graph["origin"] == F.col("_x"), "left_anti")
    out = out.join(gone, out["destination"] == F.col("_x"), "left_anti")
    if "longedge" not in graph.columns:
        return out
    touched = out.filter("longedge IS NOT NULL").select("edge", F.explode(F.array_union(F.transform("longedge.path", B.raw_edge_origin), F.array("longedge.destination"))).alias("_c"))
    touched = touched.join(gone, touched["_c"] == F.col("_x"), "left_semi").select(F.col("edge").alias("_e")).distinct()
    return out.join(touched, out["edge"] == F.col("_e"), "left").withColumn("longedge", F.when(F.col("_e").isNull(), F.col("longedge"))).drop("_e")


def downsample(graph: DataFrame, r: int, fold: Callable[[Column], Column] = F.min) -> DataFrame:
    """The graph between ancestors at ``r``: edges within one go, the weights of others that fall together are folded."""
    up = graph.select(B.parent("origin", r).alias("o"), B.parent("destination", r).alias("d"), "weight").filter("o <> d")
    folded = up.groupBy("o", "d").agg(fold(F.col("weight")).alias("weight"))
    return folded.select(X.directed_edge("o", "d").alias("edge"), F.col("o").alias("origin"), F.col("d").alias("destination"), "weight").filter("edge IS NOT NULL")


def covered_area(graph: DataFrame, reduce_by: int) -> DataFrame:
    """(component, polygons): outlines around the nodes, coarsened by ``reduce_by`` resolutions; a row for each connected
    area of coarse cells, which is what one task chains."""
    with scratch():
        n = nodes(graph)
        res = max((n.agg(F.max(B.raw_resolution("cell"))).first()[0] or 0) - reduce_by, 0)
        up = written(n.select(B.raw_parent("cell", res).alias("c")).distinct(), "coarse")
        label = flat_clusters(up, "c")
        return written(label.groupBy("component").agg(F.collect_set("c").alias("c")).select("component", X.covered_area("c", res).alias("polygons")), "areas", keep=True)


def bounding_rect(graph: DataFrame) -> DataFrame:
    """One row x0, y0, x1, y1 around the nodes' centres."""
    p = nodes(graph).select(X.to_lonlat("cell").alias("p"))
    return p.agg(F.min("p.x").alias("x0"), F.min("p.y").alias("y0"), F.max("p.x").alias("x1"), F.max("p.y").alias("y1"))


class TooManyNodes(ValueError):
    """A hull of more points than one machine should hold; ask for one around coarser cells."""


def concave_hull(graph: DataFrame, concavity: float = 2.0, reduce_by: int = 0, most: int = 200_000) -> list[tuple[float, float]]:
    """A ring around the nodes' centres, or around those of their ancestors ``reduce_by`` resolutions up. The points, of
    which there may be ``most``, meet on the driver; with more it is an error, never another answer."""
    n = nodes(graph)
    if reduce_by:
        n = n.select(B.raw_parent("cell", F.greatest(F.lit(0), B.raw_resolution("cell") - reduce_by)).alias("cell")).distinct()
    p = n.limit(most + 1).select(X.to_lonlat("cell").alias("p")).select("p.x", "p.y").toArrow()
    if p.num_rows > most:
        raise TooManyNodes(f"more than {most}")
    points = np.stack([p.column(c).to_numpy() for c in ("x", "y")], axis=1) if p.num_rows else np.zeros((0, 2))
    return [tuple(v) for v in S.concave_hull(points, concavity).tolist()] if len(points) else []


def nearest_nodes(cells: DataFrame, cell: str, node_frame: DataFrame, k_max: int) -> DataFrame:
    """(cell, node, node_type, k): for each cell all nodes at the smallest distance up to ``k_max``."""
    near = cells.select(F.col(cell).alias("cell")).distinct().select("cell", F.inline(X.grid_disk_distances("cell", 0, k_max)).alias("k", "node"))
    met = near.join(node_frame.select(F.col("cell").alias("node"), "node_type"), "node")
    w = Window.partitionBy("cell")
    return met.withColumn("_k", F.min("k").over(w)).filter("k = _k").select("cell", "node", "node_type", "k")


# ---- long edges ----------------------------------------------------------------------------------------------------


def prepare(graph: DataFrame, min_length: int = 4) -> DataFrame:
    """The graph with a nullable ``longedge`` struct<path, weight, destination> on edges that start a chain.

    A chain goes on while exactly one edge follows that doesn't lead back, starts at an edge that is not led to by
    exactly one, and counts from ``min_length`` edges on. Chains are found by pointer doubling: a round joins each
    edge's stretch with the stretch that begins where it ends, so a chain of n edges takes log2(n) rounds.
    """
    if min_length < 3:
        raise ValueError("chains have to have 3 edges at least")
    with scratch():
        return written(_prepared(graph, min_length), "prepared", keep=True)


def _prepared(graph: DataFrame, min_length: int) -> DataFrame:
    g = written(graph.select(*COLUMNS), "graph")
    follow = g.select("edge", "origin", "destination").join(g.select(F.col("edge").alias("next"), F.col("origin").alias("destination"), F.col("destination").alias("_to")), "destination").filter("_to <> origin")
    one = follow.groupBy("edge").agg(F.count("*").alias("n"), F.min("next").alias("next")).filter("n = 1").select("edge", "next")
    lead = follow.groupBy(F.col("next").alias("edge")).agg(F.count("*").alias("into"))
    start = g.join(lead, "edge", "left").filter(F.coalesce("into", F.lit(0)) != 1).select(F.col("edge").alias("start"))
    # stretches: from an edge, the edges up to (not with) ``at``
    step = written(g.select("edge", "weight").join(one, "edge", "left").select("edge", F.array("edge").alias("path"), "weight", F.col("next").alias("at")), "stretch")
    for _ in range(40):
        if step.filter("at IS NOT NULL").isEmpty():
            break
        more = step.select(F.col("edge").alias("at"), F.col("path").alias("path2"), F.col("weight").alias("w2"), F.col("at").alias("at2"))
        joined = step.join(more, "at", "left")
        # a chain that meets itself ends before the edge it has already
        cut = F.when(F.col("path2").isNull(), F.lit(0)).otherwise(F.size("path2"))
        loops = F.arrays_overlap("path", F.coalesce("path2", F.array().cast("array<bigint>")))
        first = F.array_min(F.transform(F.array_intersect("path2", "path"), lambda e: F.array_position(F.col("path2"), e)))
        keep = F.when(loops, first - 1).otherwise(cut)
        tail = F.slice(F.coalesce("path2", F.array().cast("array<bigint>")), F.lit(1), keep.cast("int"))
        step = written(joined.select("edge", F.concat("path", tail).alias("path"), F.lit(None).cast("double").alias("weight"), F.when(~loops, F.col("at2")).alias("at")), "stretch")
    weights = g.select(F.col("edge").alias("e"), F.col("weight").alias("w"))
    chains = step.join(start, step["edge"] == F.col("start"), "left_semi").filter(F.size("path") >= min_length)
    total = chains.select("edge", F.posexplode("path").alias("p", "e")).join(weights, "e").groupBy("edge").agg(F.sum("w").alias("total"))
    last = chains.select("edge", "path", F.element_at("path", -1).alias("e")).join(g.select(F.col("edge").alias("e"), F.col("destination").alias("end")), "e")
    long = last.join(total, "edge").select("edge", F.struct("path", F.col("total").alias("weight"), F.col("end").alias("destination")).alias("longedge"))
    return g.join(long, "edge", "left")


def counts(prepared: DataFrame) -> DataFrame:
    """One row: edges and longedges."""
    return prepared.agg(F.count("*").alias("edges"), F.count("longedge").alias("longedges"))


def non_overlapping(prepared: DataFrame) -> DataFrame:
    """Edges that no long edge covers, and the first edge of each long edge."""
    inner = prepared.filter("longedge IS NOT NULL").select(F.explode(F.slice("longedge.path", F.lit(2), F.size("longedge.path"))).alias("_e")).distinct()
    return prepared.join(inner, prepared["edge"] == F.col("_e"), "left_anti")
