"""Shortest paths on cell graphs (edge, origin, destination, weight).

A graph of up to ``SENT_EDGES`` edges goes to all tasks as arrays, and each origin is one Dijkstra search in a task;
origins spread over the cluster. A larger graph is never gathered: searches of all origins advance together, one hop a
round, by a join of the frontier with the edges and a minimum by (origin, node). Both give the same costs; of paths
that cost the same the one found first in order of edge ids is given.

Paths come as rows (origin, destination, cost, edges); ``edges`` is empty where both ends are one cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hexloom.functions import bits as B
from hexloom.functions import geo as X
from hexloom.operators import graph as GR
from hexloom.operators.frame import change_resolution
from hexloom.sources.shared import dropped, scratch, written

SENT_EDGES = 2_000_000
PATHS = "origin long, destination long, cost double, edges array<long>"
REACH = "origin long, cell long, cost double"


class DestinationsNotInGraph(ValueError):
    """No destination is near the graph, so that a search would visit all of it."""


@dataclass(frozen=True)
class Options:
    """How far cells may be from the graph, and how many of the nearest destinations an origin wants (None: all)."""

    max_distance_to_graph: int = 0
    num_destinations_to_reach: int | None = None


class Arrays:
    """A graph by origin."""

    def __init__(self, table: pa.Table):
        e, o, d, w = (table.column(c).to_numpy() for c in ("edge", "origin", "destination", "weight"))
        order = np.lexsort((e, o))
        self.edge, self.weight = e[order], w[order].astype(float)
        self.cells = np.unique(np.concatenate([o, d]))
        self.to = np.searchsorted(self.cells, d[order])
        self.start = np.searchsorted(np.searchsorted(self.cells, o[order]), np.arange(len(self.cells) + 1))
        #: Of edges that start a long edge: its end, its cost, the nodes between, and its edges.
        self.long: dict[int, tuple[int, float, frozenset[int], list[int]]] = {}
        if "longedge" in table.column_names:
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            ends = dict(zip(e.tolist(), d.tolist(), strict=True))
            for k, x in enumerate(table.column("longedge").to_pylist()):
                if x is not None:
                    between = frozenset(np.searchsorted(self.cells, [ends[p] for p in x["path"][:-1]]).tolist())
                    self.long[int(place[k])] = (int(np.searchsorted(self.cells, x["destination"])), float(x["weight"]), between, x["path"])

    def search(self, origin: int, wanted: set[int] | None, count: int | None, limit: float | None):
        """(cost, last edge position by node) in order of cost, stopped as soon as the wanted nodes are settled."""
        at = int(np.searchsorted(self.cells, origin))
        if at >= len(self.cells) or self.cells[at] != origin:
            return {}, {}
        cost, via, done = {at: 0.0}, {}, {}
        heap = [(0.0, at)]
        left = len(wanted) if wanted is not None else None
        if wanted is not None and count is not None:
            left = min(left, max(count, 1))
        while heap:
            c, n = heapq.heappop(heap)
            if n in done:
                continue
            done[n] = c
            if wanted is not None and n in wanted:
                left -= 1
                if left <= 0:
                    break
            for k in range(self.start[n], self.start[n + 1]):
                m, new = int(self.to[k]), c + self.weight[k]
                far = self.long.get(k) if wanted is not None else None
                if far is not None and far[2].isdisjoint(wanted):
                    m, new = far[0], c + far[1]  # nobody asks for what lies between
                if limit is not None and new > limit:
                    continue
                if m not in cost or new < cost[m]:
                    cost[m], via[m] = new, k
                    heapq.heappush(heap, (new, m))
        return done, via

    def node(self, cell: int) -> int:
        at = int(np.searchsorted(self.cells, cell))
        return at if at < len(self.cells) and self.cells[at] == cell else -1

    def edges(self, via: dict[int, int], node: int, origin_of: np.ndarray) -> list[int]:
        out = []
        while node in via:
            k = via[node]
            far = self.long.get(k)
            out += far[3][::-1] if far is not None and far[0] == node and int(self.to[k]) != node else [int(self.edge[k])]
            node = int(origin_of[k])
        return out[::-1]


def _sent(graph: DataFrame):
    """The graph as a broadcast, or None if it is too large for that."""
    g = graph.select(*GR.COLUMNS, *(["longedge"] if "longedge" in graph.columns else []))
    if g.limit(SENT_EDGES + 1).count() > SENT_EDGES:
        return None
    return g.sparkSession.sparkContext.broadcast(Arrays(g.toArrow()))


def within_threshold(graph: DataFrame, origins: DataFrame, cell: str, threshold: float) -> DataFrame:
    """(origin, cell, cost) of all cells that each origin reaches at a cost of at most ``threshold``."""
    own = origins.select(F.col(cell).cast("long").alias("origin")).distinct()
    sent = _sent(graph)
    if sent is None:
        return _relaxed(graph, own, threshold).select("origin", F.col("node").alias("cell"), "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for batch in batches:
            for o in batch.column(0).to_pylist():
                done, _ = g.search(o, None, None, threshold)
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array([o] * len(done)), pa.array(g.cells[list(done)]), pa.array(list(done.values()), pa.float64())], names=["origin", "cell", "cost"])

    return own.repartition("origin").mapInArrow(run, REACH)


def within_threshold_many(graph: DataFrame, origins: DataFrame, cell: str, threshold: float, fold=F.min) -> DataFrame:
    """(cell, cost): cells that any origin reaches, the costs of several origins folded."""
    return within_threshold(graph, origins, cell, threshold).groupBy("cell").agg(fold(F.col("cost")).alias("cost"))


def _relaxed(graph: DataFrame, origins: DataFrame, threshold: float | None = None) -> DataFrame:
    """(origin, node, cost, via) by rounds of relaxation; ``via`` is the last edge. A round's tables go with the next."""
    with scratch():
        return written(_rounds(graph, origins, threshold), "reach", keep=True)


def _rounds(graph: DataFrame, origins: DataFrame, threshold: float | None) -> DataFrame:
    g = graph.select("edge", F.col("origin").alias("node"), F.col("destination").alias("to"), F.col("weight").cast("double").alias("w"))
    known = GR.nodes(graph).select(F.col("cell").alias("origin"))
    best = written(origins.join(known, "origin", "left_semi").select("origin", F.col("origin").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("via")), "reach")
    front = best
    while True:
        new = front.join(g, "node").select("origin", F.col("to").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("edge").alias("via"))
        if threshold is not None:
            new = new.filter(F.col("cost") <= threshold)
        new = new.groupBy("origin", "node").agg(F.min(F.struct("cost", "via")).alias("m")).select("origin", "node", "m.cost", "m.via")
        old = best.select("origin", "node", F.col("cost").alias("old"))
        better = written(new.join(old, ["origin", "node"], "left").filter("old IS NULL OR cost < old").drop("old"), "front")
        if better.isEmpty():
            return best
        old = (best, front)
        best = written(best.join(better.select("origin", "node"), ["origin", "node"], "left_anti").unionByName(better), "reach")
        front = better
        for x in old:
            dropped(x)


def _walked(graph: DataFrame, reach: DataFrame, wanted: DataFrame) -> DataFrame:
    """Paths (origin, destination, cost, edges) of the wanted (origin, destination), edge by edge from their ends."""
    with scratch():
        return written(_steps(graph, reach, wanted), "paths", keep=True)


def _steps(graph: DataFrame, reach: DataFrame, wanted: DataFrame) -> DataFrame:
    g = graph.select(F.col("edge").alias("via"), F.col("origin").alias("back"))
    at = wanted.join(reach.select("origin", F.col("node").alias("destination"), "cost"), ["origin", "destination"]).select("origin", "destination", "cost", F.col("destination").alias("node"), F.array().cast("array<bigint>").alias("edges"))
    at = written(at, "walk")
    while not at.filter("node <> origin").isEmpty():
        far = at.filter("node <> origin").join(reach.select("origin", "node", "via"), ["origin", "node"]).join(g, "via")
        far = far.select("origin", "destination", "cost", F.col("back").alias("node"), F.concat(F.array("via"), "edges").alias("edges"))
        at = written(at.filter("node = origin").unionByName(far), "walk")
    return at.select("origin", "destination", "cost", "edges")


def _snapped(cells: DataFrame, cell: str, graph: DataFrame, nodes: DataFrame, options: Options, types: tuple[int, ...], also: DataFrame | None = None) -> DataFrame:
    """(node, cell): cells at the graph's resolution with the node that stands for each.

    Only the nearest ring that has nodes counts; of its nodes of the right type the smallest is taken.
    """
    res = graph.select(B.raw_resolution("origin")).first()
    if res is None:
        return cells.select(F.col(cell).alias("node"), F.col(cell).alias("cell")).limit(0)
    own = change_resolution(cells.select(F.col(cell).alias("cell")), "cell", res[0]).distinct()
    near = GR.nearest_nodes(own, "cell", nodes, options.max_distance_to_graph)
    good = F.col("node_type").isin(*types)
    if also is not None:
        near = near.join(also.select(F.col("node").alias("_o")).distinct(), F.col("node") == F.col("_o"), "left")
        good = good | F.col("_o").isNotNull()
    return near.filter(good).groupBy("cell").agg(F.min("node").alias("node")).select("node", "cell")


def shortest_paths(graph: DataFrame, origins: DataFrame, origin: str, destinations: DataFrame, destination: str, options: Options = Options()) -> DataFrame:
    """Paths from each origin to each destination, or to the nearest few of them.

    Cells of other resolutions than the graph's stand for their descendants or ancestor; cells off the graph for the
    nearest node within the options' distance. Costs and edges are those between the nodes.
    """
    nodes = written(GR.nodes(graph), "nodes")
    starts = written(_snapped(origins, origin, graph, nodes, options, (GR.ORIGIN, GR.BOTH)), "starts")
    ends = written(_snapped(destinations, destination, graph, nodes, options, (GR.DESTINATION, GR.BOTH), starts), "ends")
    if starts.isEmpty():
        return graph.sparkSession.createDataFrame([], PATHS)
    if ends.isEmpty():
        raise DestinationsNotInGraph
    paths = _between(graph, starts.select("node").distinct(), ends.select("node").distinct(), options.num_destinations_to_reach)
    out = paths.join(starts.select(F.col("node").alias("origin"), F.col("cell").alias("o")), "origin").join(ends.select(F.col("node").alias("destination"), F.col("cell").alias("d")), "destination")
    return out.select(F.col("o").alias("origin"), F.col("d").alias("destination"), "cost", "edges")


def _between(graph: DataFrame, starts: DataFrame, ends: DataFrame, count: int | None) -> DataFrame:
    sent = _sent(graph)
    if sent is not None and ends.limit(SENT_EDGES + 1).count() <= SENT_EDGES:
        wanted = sent.value.node
        nodes = {wanted(r["node"]) for r in ends.toLocalIterator()} - {-1}
        shared = graph.sparkSession.sparkContext.broadcast(nodes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, wanted = sent.value, shared.value
            origin_of = np.repeat(np.arange(len(g.cells)), np.diff(g.start))
            for batch in batches:
                for o in batch.column(0).to_pylist():
                    done, via = g.search(o, wanted, count, None)
                    hit = [n for n in done if n in wanted]
                    if hit:
                        yield pa.RecordBatch.from_arrays([pa.array([o] * len(hit)), pa.array(g.cells[hit]), pa.array([done[n] for n in hit], pa.float64()), pa.array([g.edges(via, n, origin_of) for n in hit], pa.list_(pa.int64()))], names=["origin", "destination", "cost", "edges"])

        return starts.select(F.col("node").alias("origin")).repartition("origin").mapInArrow(run, PATHS)
    reach = _relaxed(graph, starts.select(F.col("node").alias("origin")))
    hit = reach.join(ends.select("node"), "node", "left_semi")
    if count is not None:
        order = Window.partitionBy("origin").orderBy("cost", "node")
        hit = hit.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max(count, 1))
    return _walked(graph, reach, hit.select("origin", F.col("node").alias("destination")))


def differential(graph: DataFrame, origins: DataFrame, origin: str, destinations: DataFrame, destination: str, exclude: DataFrame, cell: str, options: Options = Options()) -> DataFrame:
    """(origin, before, after): arrays of paths without and with the excluded cells taken out of the graph."""
    if exclude.isEmpty():
        raise ValueError("nothing to exclude")
    frames = [origins.select(F.col(origin).alias("c")), destinations.select(F.col(destination).alias("c"))]
    res = {r["r"] for f in frames for r in f.select(B.raw_resolution("c").alias("r")).distinct().limit(2).collect()} | {graph.select(B.raw_resolution("origin")).first()[0]}
    if len(res) > 1:
        raise GR.MixedResolutions(sorted(res))

    def grouped(g: DataFrame, name: str) -> DataFrame:
        p = shortest_paths(g, origins, origin, destinations, destination, options)
        return p.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("cost", "destination", "edges"))).alias(name))

    before, after = grouped(graph, "before"), grouped(GR.exclude_cells(graph, exclude, cell), "after")
    return before.join(after, "origin", "left").withColumn("after", F.coalesce("after", F.array().cast(before.schema["before"].dataType)))


# ---- paths ---------------------------------------------------------------------------------------------------------


def path_cells(paths: DataFrame) -> DataFrame:
    """``paths`` with ``cells``, the cells that each path visits, in order."""
    start = F.when(F.size("edges") > 0, B.raw_edge_origin(F.get("edges", F.lit(0)))).otherwise(F.col("origin"))
    return paths.withColumn("cells", F.concat(F.array(start), X.edge_destinations("edges")))


def path_lengths(paths: DataFrame) -> DataFrame:
    """``paths`` with ``length_m``, the sum of the edges' boundary lengths."""
    return paths.withColumn("length_m", F.aggregate(X.edge_lengths_m("edges"), F.lit(0.0), lambda s, m: s + m))


def path_lines(paths: DataFrame) -> DataFrame:
    """``paths`` with ``points``, the line through the visited cells' centres."""
    cells = paths if "cells" in paths.columns else path_cells(paths)
    return cells.withColumn("points", X.centres("cells"))


def transformed(paths: DataFrame, *made) -> DataFrame:
    """``paths`` with something made of each path in place of its edges: ``made`` are functions of this module as
    ``path_cells``, ``path_lengths`` or ``path_lines``, or any from frame to frame."""
    for f in made:
        paths = f(paths)
    return paths.drop("edges")


def shortest_paths_map(graph: DataFrame, origins: DataFrame, origin: str, destinations: DataFrame, destination: str, *made, options: Options = Options()) -> DataFrame:
    """``shortest_paths`` with something made of each path where it is found, so that its edges are not kept."""
    return transformed(shortest_paths(graph, origins, origin, destinations, destination, options), *made)


def differential_map(graph: DataFrame, origins: DataFrame, origin: str, destinations: DataFrame, destination: str, exclude: DataFrame, cell: str, *made, options: Options = Options()) -> DataFrame:
    """``differential`` of what is made of each path: (origin, before, after), arrays of what is left of the paths."""
    if exclude.isEmpty():
        raise ValueError("nothing to exclude")

    def grouped(g: DataFrame, name: str) -> DataFrame:
        p = shortest_paths_map(g, origins, origin, destinations, destination, *made, options=options)
        rest = [c for c in p.columns if c not in ("origin", "cost", "destination")]
        return p.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("cost", "destination", *rest))).alias(name))

    before, after = grouped(graph, "before"), grouped(GR.exclude_cells(graph, exclude, cell), "after")
    return before.join(after, "origin", "left").withColumn("after", F.coalesce("after", F.array().cast(before.schema["before"].dataType)))
