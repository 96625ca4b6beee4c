"""Spatial predicates and joins on cell or edge columns.

No index object: a query region becomes comparisons on the centre or envelope, which run first, and an exact test for
the rows that pass; for joins, cells meet regions on a common ancestor. Invalid ids give null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.functions import bits as B
from hexloom.functions import geo as X
from hexloom.kernel import shapes as S
from hexloom.sources.shared import written


def coordinate(c: Column | str, kind: str = "cell") -> Column:
    """struct<x, y>: a cell's centre, or the middle between an edge's two centres."""
    if kind == "cell":
        return X.to_lonlat(c)
    a, b = X.to_lonlat(B.edge_origin(c)), X.to_lonlat(X.edge_destination(c))
    return F.when(B.is_valid_edge(c), F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y")))


def with_coordinate(df: DataFrame, c: str, kind: str = "cell", x: str = "x", y: str = "y") -> DataFrame:
    return df.withColumn("_p", coordinate(c, kind)).withColumn(x, F.col("_p.x")).withColumn(y, F.col("_p.y")).drop("_p")


def point_in_rect(x, y, rect: tuple[float, float, float, float]) -> Column:
    """Whether a point is in (x0, y0, x1, y1), sides included."""
    x, y = B.col(x), B.col(y)
    return x.between(rect[0], rect[2]) & y.between(rect[1], rect[3])


def point_within(x, y, point: tuple[float, float], distance: float) -> Column:
    """Whether a point is within a planar distance in degrees."""
    x, y = B.col(x), B.col(y)
    return F.hypot(x - F.lit(point[0]), y - F.lit(point[1])) <= distance


def envelopes_intersect(e: Column, rect: tuple[float, float, float, float]) -> Column:
    """Whether struct<x0, y0, x1, y1> shares a point with a rectangle."""
    return (e["x0"] <= rect[2]) & (e["x1"] >= rect[0]) & (e["y0"] <= rect[3]) & (e["y1"] >= rect[1])


def envelope_within(e: Column, point: tuple[float, float], distance: float, squared: bool = False) -> Column:
    """Whether an envelope is within a planar distance in degrees of a point; ``squared``: the distance is a square."""
    px, py = (F.lit(float(v)) for v in point)
    dx = F.greatest(e["x0"] - px, px - e["x1"], F.lit(0.0))
    dy = F.greatest(e["y0"] - py, py - e["y1"], F.lit(0.0))
    return dx * dx + dy * dy <= (distance if squared else distance * distance)


def _rect_of(polygon: list) -> tuple[float, float, float, float]:
    p = np.concatenate([np.asarray(r, float) for r in polygon])
    return (*p.min(axis=0).tolist(), *p.max(axis=0).tolist())


def geometries_intersect(df: DataFrame, c: str, polygons: list, name: str, by: str = "rect", kind: str = "cell", refine: bool = True) -> DataFrame:
    """``df`` with a mask ``name``: whether the cell meets any of the polygons (each a list of rings).

    ``by`` "point" asks for the centre inside a polygon, "rect" for the cell's polygon (or the edge's line) touching
    one. Without ``refine`` the comparison of envelopes (or of the centre with the polygon's envelope) is the answer.
    """
    out = with_coordinate(df, c, kind, "_x", "_y") if by == "point" else df.withColumn("_e", X.envelope(c, kind))
    near = [point_in_rect("_x", "_y", _rect_of(p)) if by == "point" else envelopes_intersect(F.col("_e"), _rect_of(p)) for p in polygons]
    exact = [X.contains_point("_x", "_y", p) if by == "point" else X.touches(c, p, kind) for p in polygons]
    hit = F.lit(False)
    for n, e in zip(near, exact, strict=True):
        hit = hit | ((n & e) if refine else n)
    valid = B.is_valid(c) if kind == "cell" else B.is_valid_edge(c)
    return out.withColumn(name, F.when(valid, hit)).drop("_x", "_y", "_e")


def rect(x0: float, y0: float, x1: float, y1: float) -> list:
    """A rectangle as a polygon."""
    return [[tuple(p) for p in r.tolist()] for r in S.box(x0, y0, x1, y1)]


def region_join(cells: DataFrame, c: str, regions: DataFrame, polygon: str, coarse: int) -> DataFrame:
    """Rows of ``cells`` with the regions that hold their centres: each row once for each region, so that rows that
    repeat, and regions that are equal, are all kept.

    A region is covered by cells of ``coarse``, and by their neighbours, as descendants reach over their ancestor's
    sides; a distinct cell meets it on its one ancestor there, in an equi-join, so nothing meets twice, however often a cell
    repeats. Only ids are dealt out until it is known that a region has cells near it; the exact test runs only on what met,
    and rows then take their cell's regions. No side is sent whole to all tasks: as files are small beside their rows,
    Spark's estimates are no ground for that.
    """
    tasks = cells.sparkSession.sparkContext.defaultParallelism * 4
    numbered = written(regions.repartition(tasks).withColumn("_k", F.monotonically_increasing_id()), "regions")
    shape = numbered.select("_k", F.col(polygon).alias("_s"))
    cover = shape.select("_k", F.explode(X.polygon_cells_around("_s", coarse)).alias("_r"))
    own = cells.select(F.col(c).alias("_h")).distinct().withColumn("_r", B.parent("_h", coarse))
    near = cover.join(own.select("_r").distinct().hint("merge"), "_r", "left_semi").join(shape.hint("merge"), "_k")
    met = near.join(own.withColumn("_p", X.to_lonlat("_h")).hint("merge"), "_r").filter(X.inside("_p", "_s"))
    found = met.select("_h", "_k").join(numbered.hint("merge"), "_k").drop("_k")
    return cells.withColumn("_h", F.col(c)).join(found.hint("merge"), "_h").drop("_h")
