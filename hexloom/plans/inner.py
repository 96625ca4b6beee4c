"""Queries on cells whose geometry SQL can follow: those in the middle of the base cells that sit on a face's centre.

Such a cell, and all that lies near it, is on one face and in one base cell, so its place is a sum of one vector for each
digit, and its centre and corners are one gnomonic projection away. The SQL is written from these published formulas and
shares no code with the kernel but the table of face centres.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions import bits as B
from hexloom.functions import geo as X
from hexloom.kernel import grid as G
from hexloom.operators import collections as CO
from hexloom.operators import frame as FR
from hexloom.operators import graph as GR
from hexloom.operators import raster as RA
from hexloom.operators import routing as RO
from hexloom.operators import spatial as SP
from hexloom.plans import duck as D
from hexloom.plans import inputs as I
from hexloom.plans.registry import query

RES, SPREAD = 4, 7**3
_AT_CENTRE = [int(b) for b in range(122) if tuple(G.HOME_AT[b]) == (0, 0) and not G.PENTAGON[b]][:16]
_FACES = [int(G.HOME_FACE[b]) for b in _AT_CENTRE]
_STEP = {0: (0, 0), 1: (-1, -1), 2: (0, 1), 3: (-1, 0), 4: (1, 0), 5: (0, -1), 6: (1, 1)}  # fixed: digits as (i - k, j - k)
_TAIL = (1 << 59) | (RES << 52) | ((1 << ((15 - RES) * 3)) - 1)


def _vectors(res: int) -> list[list[tuple[int, int]]]:
    """For each resolution up to ``res`` what each digit adds to (a, b) at ``res``."""
    out = []
    for r in range(1, res + 1):
        row = []
        for d in range(7):
            a, b = _STEP[d]
            for finer in range(r + 1, res + 1):
                a, b = (2 * a + b, 3 * b - a) if finer % 2 else (3 * a - b, a + 2 * b)
            row.append((a, b))
        out.append(row)
    return out


def _sum(digits: list[str], axis: int, res: int) -> str:
    return "(" + " + ".join(f"{[v[axis] for v in _vectors(res)[r]]}[{d} + 1]" for r, d in enumerate(digits)) + ")"


def _place(c: str, axis: int, res: int = RES) -> str:
    return _sum([D.digit(c, str(r)) for r in range(1, res + 1)], axis, res)


def _list(values) -> str:
    return "[" + ", ".join(f"{v!r}" for v in values) + "]"


INNER = f"""here AS (SELECT p_partkey, p_size, t, cell, {_place('cell', 0)} AS a, {_place('cell', 1)} AS b FROM (
  SELECT p_partkey, p_size, (p_partkey // 97) % {len(_AT_CENTRE)} + 1 AS t, (CAST({_list(_AT_CENTRE)}[(p_partkey // 97) % {len(_AT_CENTRE)} + 1] AS BIGINT) << 45) | {_TAIL & ~(511 << 33)}
    | {" | ".join(f"(((p_partkey * 5 // {7**k}) % 7) << {(15 - RES + k) * 3})" for k in range(3))} AS cell FROM part))"""


def inner_cells(spark, sf: str) -> DataFrame:
    """Cells of resolution 4 around face centres, from the keys of ``part``."""
    k = F.col("p_partkey")
    turn = F.call_function("pmod", F.call_function("div", k, F.lit(97).cast("long")), F.lit(len(_AT_CENTRE)).cast("long"))
    base = F.get(F.array(*[F.lit(b).cast("long") for b in _AT_CENTRE]), turn.cast("int"))
    return I.dealt(I.table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", "p_size", I._cell(base, F.call_function("pmod", k * 5, F.lit(SPREAD).cast("long")), RES).alias("cell"))


REL = f"""rel AS (SELECT {_sum([f"d{r}" for r in range(1, RES + 1)], 0, RES)} AS ra, {_sum([f"d{r}" for r in range(1, RES + 1)], 1, RES)} AS rb, {" | ".join(f"(d{r} << {(15 - r) * 3})" for r in range(1, RES + 1))} AS bits
  FROM (SELECT {", ".join(f"n // {7 ** (RES - r)} % 7 AS d{r}" for r in range(1, RES + 1))} FROM range({7**RES}) s(n)))"""
HEAD = f"((CAST({_list(_AT_CENTRE)}[t] AS BIGINT) << 45) | {_TAIL & ~(((1 << 12) - 1) << 33)})"
_APART = "greatest(abs({a} - {c}), abs({b} - {d}), abs(({a} - {b}) - ({c} - {d})))"
_K = _APART.format(a="ra", b="rb", c="a", d="b")


def _near(least: int, most: int) -> str:
    """Cells from ``least`` to ``most`` steps away."""
    return f"near AS (SELECT p_partkey, t, cell, {HEAD} | bits AS other, {_K} AS k, ra, rb, ra - a AS da, rb - b AS db FROM here JOIN rel ON {_K} BETWEEN {least} AND {most})"


def _direction(da: str, db: str) -> str:
    return "CASE " + " ".join(f"WHEN {da} = {v[0]} AND {db} = {v[1]} THEN {d}" for d, v in _STEP.items() if d) + " END"


# ---- disks, edges, local coordinates -------------------------------------------------------------------------------


@query("grid_disk", f"WITH {INNER}, {REL}, {_near(0, 2)} SELECT p_partkey, other AS near FROM near")
def grid_disk(spark, sf):
    return inner_cells(spark, sf).select("p_partkey", F.explode(X.grid_disk("cell", 2)).alias("near"))


@query("grid_ring", f"WITH {INNER}, {REL}, {_near(2, 2)} SELECT p_partkey, other AS near FROM near")
def grid_ring(spark, sf):
    return inner_cells(spark, sf).select("p_partkey", F.explode(X.grid_ring("cell", 2, strict=True)).alias("near"))


@query("grid_distance", f"WITH {INNER}, {REL}, {_near(1, 3)} SELECT p_partkey, other AS near, k, k AS distance FROM near")
def grid_distance(spark, sf):
    c = inner_cells(spark, sf).select("p_partkey", "cell", F.inline(X.grid_disk_distances("cell", 1, 3)).alias("k", "near"))
    return c.select("p_partkey", "near", "k", X.grid_distance("cell", "near").alias("distance"))


_PAIRED = f"pairs AS (SELECT x.p_partkey, x.cell, y.cell AS other, {_APART.format(a='x.a', b='x.b', c='y.a', d='y.b')} AS k FROM here x JOIN here y ON x.t = y.t AND y.p_partkey = x.p_partkey + 3)"


def _pairs(spark, sf):
    c = inner_cells(spark, sf)
    other = c.select((F.col("p_partkey") - 3).alias("p_partkey"), F.col("cell").alias("other"))
    same = B.base_cell("cell") == B.base_cell("other")
    return c.select("p_partkey", "cell").join(other, "p_partkey").filter(same)


@query("grid_path", f"WITH {INNER}, {_PAIRED} SELECT p_partkey, k + 1 AS cells, cell AS first, other AS last, TRUE AS unbroken FROM pairs")
def grid_path(spark, sf):
    p = _pairs(spark, sf).select("p_partkey", X.grid_path("cell", "other").alias("path"))
    return p.select("p_partkey", F.size("path").alias("cells"), F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("last"), X.unbroken("path").alias("unbroken"))


@query("are_neighbors", f"WITH {INNER}, {_PAIRED} SELECT p_partkey, k = 1 AS neighbors, k AS distance FROM pairs")
def are_neighbors(spark, sf):
    return _pairs(spark, sf).select("p_partkey", X.are_neighbors("cell", "other").alias("neighbors"), X.grid_distance("cell", "other").alias("distance"))


@query("local_ij_round_trip", f"WITH {INNER}, {REL}, {_near(1, 1)} SELECT p_partkey, other AS near, ra AS i, rb AS j, other AS back, da + ra AS plus_i, db AS minus_j FROM near")
def local_ij_round_trip(spark, sf):
    c = inner_cells(spark, sf).select("p_partkey", "cell", F.explode(X.grid_ring("cell", 1)).alias("near"))
    c = c.withColumn("ij", X.to_local_ij("cell", "near")).withColumn("own", X.to_local_ij("cell", "cell")).withColumn("step", B.ij_sub("ij", "own"))
    return c.select("p_partkey", "near", "ij.i", "ij.j", X.from_local_ij("cell", "ij").alias("back"), B.ij_add("ij", "step")["i"].alias("plus_i"), F.col("step.j").alias("minus_j"))


_EDGES = f"edges AS (SELECT *, {D.edge('cell', _direction('da', 'db'))} AS edge, {D.edge('other', _direction('-da', '-db'))} AS back FROM near)"


@query("directed_edges", f"WITH {INNER}, {REL}, {_near(1, 1)}, {_EDGES} SELECT p_partkey, edge, cell AS origin, other AS destination, back AS reversed, edge AS again, TRUE AS valid FROM edges")
def directed_edges(spark, sf):
    e = inner_cells(spark, sf).select("p_partkey", F.explode(B.outgoing_edges("cell")).alias("edge"))
    e = e.withColumn("c", X.edge_cells("edge"))
    return e.select("p_partkey", "edge", "c.origin", "c.destination", X.edge_reversed("edge").alias("reversed"), X.directed_edge("c.origin", "c.destination").alias("again"), B.is_valid_edge("edge").alias("valid"))


@query("edges_around", f"""WITH {INNER}, {REL}, {_near(1, 1)}, {_EDGES}, one AS (SELECT p_partkey, edge, back, other, cell, ra, rb, t FROM edges WHERE {_direction('da', 'db')} = 4),
  onward AS (SELECT one.p_partkey, one.edge, {D.edge('one.other', _direction('rel.ra - one.ra', 'rel.rb - one.rb'))} AS e FROM one, rel WHERE {_APART.format(a='rel.ra', b='rel.rb', c='one.ra', d='one.rb')} = 1)
  SELECT p_partkey, 'on' AS way, onward.e AS other FROM onward JOIN one USING (p_partkey, edge) WHERE onward.e <> one.back
  UNION ALL SELECT x.p_partkey, 'before', x.back FROM edges x JOIN one USING (p_partkey) WHERE x.edge <> one.edge""")
def edges_around(spark, sf):
    e = inner_cells(spark, sf).select("p_partkey", F.get(B.outgoing_edges("cell"), F.lit(3)).alias("edge"))
    on = e.select("p_partkey", F.lit("on").alias("way"), F.explode(FR.following_edges("edge")).alias("other"))
    before = FR.previous_edges(e.select("edge").distinct(), "edge").withColumnRenamed("previous", "other")
    return on.unionByName(e.join(before, "edge").select("p_partkey", F.lit("before").alias("way"), "other"))


@query("cells_to_edges", f"WITH {INNER}, {REL}, {_near(1, 1)}, {_EDGES} SELECT p_partkey, edge FROM edges WHERE {_direction('da', 'db')} = 6")
def cells_to_edges(spark, sf):
    c = inner_cells(spark, sf).select("p_partkey", F.posexplode(F.array("cell", "cell", X.edge_destination(F.get(B.outgoing_edges("cell"), F.lit(5))))).alias("p", "c"))
    return FR.cells_to_edges(c, "c", "p", ["p_partkey"]).select("p_partkey", "edge")


# ---- geometry ------------------------------------------------------------------------------------------------------

_SCALE = 0.38196601125010500003 / math.sqrt(7) ** RES  # fixed: the gnomonic length of a step at resolution 0
_LAT, _LON = ([float(v) for v in G.FACE_CENTRES[_FACES, k]] for k in (0, 1))
_AXIS = [float(np.atleast_1d(G.FACE_AXES[f])[0]) for f in _FACES]


def _geo(name: str, source: str, x: str, y: str) -> str:
    """``source`` with lon and lat (degrees) of the point (x, y) on the face of ``t``."""
    return f"""{name} AS (SELECT * EXCLUDE (d, az, lat0, lon0, latr), degrees(latr) AS lat,
      degrees(atan2(sin(lon0 + dl), cos(lon0 + dl))) AS lon FROM (SELECT *, atan2(sin(az) * sin(d) * cos(lat0), cos(d) - sin(lat0) * sin(latr)) AS dl FROM (
        SELECT *, asin(sin(lat0) * cos(d) + cos(lat0) * sin(d) * cos(az)) AS latr FROM (
          SELECT *, atan(sqrt(({x}) * ({x}) + ({y}) * ({y})) * {_SCALE!r}) AS d, {_list(_AXIS)}[t] - atan2({y}, {x}) AS az, {_list(_LAT)}[t] AS lat0, {_list(_LON)}[t] AS lon0 FROM {source}))))"""


_X, _Y = "({a} - 0.5 * {b})", f"({{b}} * {math.sqrt(3) / 2!r})"
CENTRES = _geo("centres", "here", _X.format(a="a", b="b"), _Y.format(b="b"))
CORNERS = _geo(
    "corners",
    "(SELECT here.*, s.k AS k FROM here, range(6) s(k))",
    f"({_X.format(a='a', b='b')} + cos(radians(30 + 60 * k)) * {1 / math.sqrt(3)!r})",
    f"({_Y.format(b='b')} + sin(radians(30 + 60 * k)) * {1 / math.sqrt(3)!r})",
)


@query("cell_centre", f"WITH {INNER}, {CENTRES} SELECT p_partkey, round(lon, 9) AS lon, round(lat, 9) AS lat FROM centres")
def cell_centre(spark, sf):
    c = inner_cells(spark, sf).withColumn("p", X.to_lonlat("cell"))
    return c.select("p_partkey", F.round("p.x", 9).alias("lon"), F.round("p.y", 9).alias("lat"))


@query("cell_of_a_point", f"WITH {INNER} SELECT p_partkey, cell AS c0, cell AS c1, cell AS c2, cell AS c3 FROM here")
def cell_of_a_point(spark, sf):
    """Points nine tenths of the way from the centre to a corner are in the cell."""
    c = inner_cells(spark, sf).withColumn("p", X.to_lonlat("cell")).withColumn("ring", X.boundary("cell"))
    inside = [X.from_lonlat(F.col("p.x") * 0.1 + F.col("ring")[k]["x"] * 0.9, F.col("p.y") * 0.1 + F.col("ring")[k]["y"] * 0.9, RES) for k in (0, 2, 4)]
    wide = F.abs(F.col("ring")[0]["x"] - F.col("p.x")) < 90  # not across the antimeridian
    return c.select("p_partkey", X.from_lonlat("p.x", "p.y", RES).alias("c0"), *[F.when(wide, h).otherwise(F.col("cell")).alias(f"c{k + 1}") for k, h in enumerate(inside)])


@query("cell_boundary", f"WITH {INNER}, {CORNERS} SELECT p_partkey, k AS corner, round(lon, 8) AS lon, round(lat, 8) AS lat FROM corners")
def cell_boundary(spark, sf):
    c = inner_cells(spark, sf).select("p_partkey", F.posexplode(X.boundary("cell", close=False)).alias("corner", "p"))
    return c.select("p_partkey", F.col("corner").cast("long").alias("corner"), F.round("p.x", 8).alias("lon"), F.round("p.y", 8).alias("lat"))


_XYZ = "cos(radians({t}.lat)) * cos(radians({t}.lon)) AS {t}x, cos(radians({t}.lat)) * sin(radians({t}.lon)) AS {t}y, sin(radians({t}.lat)) AS {t}z"
_DOT = "({p}x * {q}x + {p}y * {q}y + {p}z * {q}z)"
AREAS = f"""areas AS (SELECT p_partkey, sum(2 * atan2(abs(mx * (vy * wz - vz * wy) + my * (vz * wx - vx * wz) + mz * (vx * wy - vy * wx)),
    1 + {_DOT.format(p='m', q='v')} + {_DOT.format(p='v', q='w')} + {_DOT.format(p='w', q='m')})) AS rads2 FROM (
  SELECT m.p_partkey, {_XYZ.format(t='m')}, {_XYZ.format(t='v')}, {_XYZ.format(t='w')} FROM centres m JOIN corners v USING (p_partkey) JOIN corners w ON w.p_partkey = v.p_partkey AND w.k = (v.k + 1) % 6) GROUP BY p_partkey)"""


@query("cell_area", f"WITH {INNER}, {CENTRES}, {CORNERS}, {AREAS} SELECT p_partkey, round(rads2 * 1e6, 9) AS micro_rads2, round(rads2 * {6371.007180918475**2!r}, 5) AS km2, round(rads2 * {6371.007180918475**2!r} * 1e6, 0) AS m2 FROM areas")
def cell_area(spark, sf):
    return inner_cells(spark, sf).select("p_partkey", F.round(X.area_rads2("cell") * 1e6, 9).alias("micro_rads2"), F.round(X.area_km2("cell"), 5).alias("km2"), F.round(X.area_m2("cell"), 0).alias("m2"))


_HAV = "2 * asin(sqrt(pow(sin(radians(w.lat - v.lat) / 2), 2) + cos(radians(v.lat)) * cos(radians(w.lat)) * pow(sin(radians(w.lon - v.lon) / 2), 2)))"
SIDES = f"""sides AS (SELECT v.p_partkey, v.cell, [6, 2, 3, 1, 5, 4][v.k + 1] AS d, {_HAV} AS rads, v.lon AS lon0, v.lat AS lat0, w.lon AS lon1, w.lat AS lat1 FROM corners v JOIN corners w ON w.p_partkey = v.p_partkey AND w.k = (v.k + 1) % 6)"""


@query("edge_length", f"WITH {INNER}, {CORNERS}, {SIDES} SELECT p_partkey, {D.edge('cell', 'd')} AS edge, round(rads * 1e6, 5) AS micro_rads, round(rads * 6371.007180918475, 6) AS km, round(rads * 6371007.180918475, 3) AS m, round(rads * 6371007.180918475 * {math.sqrt(3)!r}, 2) AS centres_m FROM sides")
def edge_length(spark, sf):
    e = inner_cells(spark, sf).select("p_partkey", F.explode(B.outgoing_edges("cell")).alias("edge"))
    return e.select("p_partkey", "edge", F.round(X.edge_length_rads("edge") * 1e6, 5).alias("micro_rads"), F.round(X.edge_length_km("edge"), 6).alias("km"), F.round(X.edge_length_m("edge"), 3).alias("m"), F.round(X.centroid_distance_m("edge"), 2).alias("centres_m"))


@query("edge_boundary", f"WITH {INNER}, {CORNERS}, {SIDES} SELECT p_partkey, {D.edge('cell', 'd')} AS edge, 2 AS points, round(lon0 + lon1, 6) AS lon_sum, round(lat0 + lat1, 6) AS lat_sum FROM sides")
def edge_boundary(spark, sf):
    e = inner_cells(spark, sf).select("p_partkey", F.explode(B.outgoing_edges("cell")).alias("edge")).withColumn("line", X.edge_boundary("edge"))
    total = lambda k: F.round(F.aggregate("line", F.lit(0.0), lambda s, p: s + p[k]), 6)
    return e.select("p_partkey", "edge", F.size("line").alias("points"), total("x").alias("lon_sum"), total("y").alias("lat_sum"))


_FAR = _geo("far", "(SELECT near.*, near.ra AS a, near.rb AS b FROM near)", _X.format(a="ra", b="rb"), _Y.format(b="rb"))


@query("edge_line", f"WITH {INNER}, {REL}, {_near(1, 1)}, {CENTRES}, {_FAR} SELECT c.p_partkey, far.other AS destination, round(c.lon, 7) AS x0, round(c.lat, 7) AS y0, round(far.lon, 7) AS x1, round(far.lat, 7) AS y1, round((c.lat + far.lat) / 2, 7) AS middle FROM centres c JOIN far USING (p_partkey)")
def edge_line(spark, sf):
    e = inner_cells(spark, sf).select("p_partkey", F.explode(B.outgoing_edges("cell")).alias("edge")).withColumn("l", X.edge_line("edge"))
    ends = [F.round(F.col("l")[k][v], 7).alias(f"{v}{k}") for k in (0, 1) for v in ("x", "y")]
    return e.select("p_partkey", X.edge_destination("edge").alias("destination"), *ends, F.round(SP.coordinate("edge", "edge")["y"], 7).alias("middle"))


@query("envelope", f"WITH {INNER}, {CORNERS} SELECT p_partkey, round(min(lon), 7) AS x0, round(min(lat), 7) AS y0, round(max(lon), 7) AS x1, round(max(lat), 7) AS y1 FROM corners GROUP BY p_partkey")
def envelope(spark, sf):
    return inner_cells(spark, sf).select("p_partkey", X.envelope("cell").alias("e")).select("p_partkey", *[F.round(f"e.{c}", 7).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("bounding_rect", f"WITH {INNER}, {CORNERS} SELECT round(min(lon), 7) AS x0, round(min(lat), 7) AS y0, round(max(lon), 7) AS x1, round(max(lat), 7) AS y1 FROM corners")
def bounding_rect(spark, sf):
    return FR.bounding_rect(inner_cells(spark, sf), "cell").select(*[F.round(c, 7).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("cell_vertexes", f"WITH {INNER}, {CORNERS} SELECT p_partkey, round(lon, 6) AS lon, round(lat, 6) AS lat, TRUE AS valid FROM corners")
def cell_vertexes(spark, sf):
    v = inner_cells(spark, sf).select("p_partkey", F.explode(X.vertex_ids("cell")).alias("v")).withColumn("p", X.vertex_to_lonlat("v"))
    return v.select("p_partkey", F.round("p.x", 6).alias("lon"), F.round("p.y", 6).alias("lat"), X.is_valid_vertex("v").alias("valid"))


@query("linked_polygons", f"WITH {INNER}, {CORNERS} SELECT p_partkey, 1 AS polygons, 19 AS outer_points, round(sum(lat), 5) AS hole_lat, round(sum(cos(radians(lon))), 6) AS hole_lon FROM corners GROUP BY p_partkey")
def linked_polygons(spark, sf):
    """The ring around a cell is one polygon, whose hole is the cell."""
    c = inner_cells(spark, sf).select("p_partkey", X.dissolve(X.grid_ring("cell", 1)).alias("ps"))
    hole = F.slice(F.element_at(F.col("ps")[0], 2), 1, 6)
    return c.select("p_partkey", F.size("ps").alias("polygons"), F.size(F.col("ps")[0][0]).alias("outer_points"), F.round(F.aggregate(hole, F.lit(0.0), lambda s, p: s + p["y"]), 5).alias("hole_lat"), F.round(F.aggregate(hole, F.lit(0.0), lambda s, p: s + F.cos(F.radians(p["x"]))), 6).alias("hole_lon"))


#: A triangle for points, in degrees.
TRIANGLE = [(-150.0, -60.0), (160.0, -20.0), (20.0, 75.0)]


def _left(k: int) -> str:
    (x0, y0), (x1, y1) = TRIANGLE[k], TRIANGLE[(k + 1) % 3]
    return f"({x1 - x0!r} * (lat - {y0!r}) - {y1 - y0!r} * (lon - {x0!r}) > 0)"


_IN_TRIANGLE = " AND ".join(_left(k) for k in range(3))


@query("geometries_intersect", f"WITH {INNER}, {CENTRES} SELECT p_partkey, ({_IN_TRIANGLE}) OR (lon BETWEEN 100 AND 170 AND lat BETWEEN 10 AND 60) AS hit FROM centres")
def geometries_intersect(spark, sf):
    return SP.geometries_intersect(inner_cells(spark, sf).select("p_partkey", "cell"), "cell", [[TRIANGLE], SP.rect(100, 10, 170, 60)], "hit", by="point").select("p_partkey", "hit")


@query("spatial_coordinates", f"WITH {INNER}, {CENTRES} SELECT p_partkey, lon BETWEEN -60 AND 60 AND lat BETWEEN -40 AND 50 AS in_rect, sqrt(pow(lon - 10, 2) + pow(lat - 20, 2)) <= 60 AS near FROM centres")
def spatial_coordinates(spark, sf):
    c = SP.with_coordinate(inner_cells(spark, sf), "cell")
    return c.select("p_partkey", SP.point_in_rect("x", "y", (-60.0, -40.0, 60.0, 50.0)).alias("in_rect"), SP.point_within("x", "y", (10.0, 20.0), 60.0).alias("near"))


_BOX = "boxes AS (SELECT p_partkey, min(lon) AS x0, min(lat) AS y0, max(lon) AS x1, max(lat) AS y1 FROM corners GROUP BY p_partkey)"


@query("envelope_masks", f"""WITH {INNER}, {CORNERS}, {_BOX} SELECT p_partkey, x0 <= 60 AND x1 >= -60 AND y0 <= 50 AND y1 >= -40 AS touches,
  pow(greatest(x0 - 10, 10 - x1, 0), 2) + pow(greatest(y0 - 20, 20 - y1, 0), 2) <= 3600 AS near FROM boxes""")
def envelope_masks(spark, sf):
    c = inner_cells(spark, sf).withColumn("e", X.envelope("cell"))
    return c.select("p_partkey", SP.envelopes_intersect(F.col("e"), (-60.0, -40.0, 60.0, 50.0)).alias("touches"), SP.envelope_within(F.col("e"), (10.0, 20.0), 60.0).alias("near"))


_GRID = _geo("every", f"(SELECT t, ra, rb, {HEAD} | bits AS cell FROM rel, range(1, {len(_AT_CENTRE) + 1}) s(t))", _X.format(a="ra", b="rb"), _Y.format(b="rb"))
_HOUSE = [(-0.13, -0.07), (0.77, -0.07), (0.77, 0.43), (0.32, 0.73), (-0.13, 0.43)]  # convex, counter-clockwise


def _in_house(x: str, y: str) -> str:
    out = []
    for (x0, y0), (x1, y1) in zip(_HOUSE, _HOUSE[1:] + _HOUSE[:1], strict=True):
        out.append(f"({x1 - x0!r} * ({y} - {y0!r}) - {y1 - y0!r} * ({x} - {x0!r}) > 0)")
    return " AND ".join(out)


@query("polyfill", f"WITH {INNER}, {CENTRES}, {REL}, {_GRID} SELECT c.p_partkey, e.cell FROM centres c JOIN every e ON e.t = c.t AND {_in_house('(e.lon - c.lon)', '(e.lat - c.lat)')}")
def polyfill(spark, sf):
    """Cells whose centres are in a pentagon around a cell's centre."""
    p = inner_cells(spark, sf).select("p_partkey", X.to_lonlat("cell").alias("c"))
    ring = F.array(*[F.struct((F.col("c.x") + x).alias("x"), (F.col("c.y") + y).alias("y")) for x, y in _HOUSE])
    return FR.polygon_cells(p.select("p_partkey", F.array(ring).alias("p")), "p", RES).drop("p")


@query("region_join", f"WITH {INNER}, {CENTRES}, {I.CUSTOMER_POINTS} SELECT c.p_partkey, g.c_custkey AS region FROM centres c JOIN points g ON c.lon > g.lon AND c.lon < g.lon + 3 AND c.lat > g.lat AND c.lat < g.lat + 2")
def region_join(spark, sf):
    corner = lambda x, y: F.struct((F.col("lon") + x).alias("x"), (F.col("lat") + y).alias("y"))
    regions = I.customer_points(spark, sf).select(F.col("c_custkey").alias("region"), F.array(F.array(*[corner(x, y) for x, y in ((0, 0), (3, 0), (3, 2), (0, 2))])).alias("polygon"))
    return SP.region_join(inner_cells(spark, sf).select("p_partkey", "cell"), "cell", regions, "polygon", 3).select("p_partkey", "region")


_X0, _Y0 = round(math.degrees(_LON[0])) - 3.75, round(math.degrees(_LAT[0])) + 3.75


@query("raster_to_cells", f"""WITH {REL}, {_GRID}, pixels AS (SELECT p_partkey // 60 % 60 AS r, p_partkey % 60 AS c, min(p_size * 7 % 4) AS value FROM part GROUP BY ALL)
  SELECT p.value, e.cell FROM every e JOIN pixels p ON e.t = 1 AND floor((e.lon - {_X0!r}) / 0.125) = p.c AND floor(({_Y0!r} - e.lat) / 0.125) = p.r WHERE p.value <> 0""")
def raster_to_cells(spark, sf):
    """A raster of 60 x 60 pixels, whose places and values come from the parts."""
    k = F.col("p_partkey")
    t = RA.Transform.from_gdal((_X0, 0.125, 0.0, _Y0, 0.0, -0.125))
    pixels = I.table(spark, sf, "part").groupBy(F.expr("p_partkey div 60 % 60").cast("int").alias("row"), (k % 60).cast("int").alias("col")).agg(F.min(F.col("p_size") * 7 % 4).alias("value"))
    return RA.to_cells(pixels, (60, 60), t, RES, nodata=0, compact=False)


_FILLED = f"filled AS (SELECT c.p_partkey, e.cell FROM centres c JOIN every e ON e.t = c.t AND {_in_house('(e.lon - c.lon)', '(e.lat - c.lat)')})"


@query("geometry_cells", f"""WITH {INNER}, {CENTRES}, {REL}, {_GRID}, {_FILLED}, two AS (SELECT x.p_partkey, y.cell FROM here x JOIN here y ON y.p_partkey = x.p_partkey + 3)
  SELECT p_partkey, 'point' AS kind, cell FROM here WHERE p_partkey % 4 = 0 UNION SELECT p_partkey, 'points', cell FROM here WHERE p_partkey % 4 = 1 UNION SELECT p_partkey, 'points', cell FROM two WHERE p_partkey % 4 = 1
  UNION SELECT p_partkey, 'polygons', cell FROM filled WHERE p_partkey % 4 = 2 UNION SELECT p_partkey, 'collection', cell FROM filled WHERE p_partkey % 4 = 3 UNION SELECT p_partkey, 'collection', cell FROM two WHERE p_partkey % 4 = 3""")
def geometry_cells(spark, sf):
    """GeoJSON of four kinds: points, several points, overlapping polygons, and collections of a point and a polygon."""
    c = inner_cells(spark, sf).select("p_partkey", X.to_lonlat("cell").alias("c"))
    far = c.select((F.col("p_partkey") - 3).alias("p_partkey"), F.col("c").alias("d"))
    c = c.join(far, "p_partkey", "left")
    at = lambda p: F.concat(F.lit("["), F.col(f"{p}.x").cast("string"), F.lit(","), F.col(f"{p}.y").cast("string"), F.lit("]"))
    corner = lambda x, y: F.concat(F.lit("["), (F.col("c.x") + x).cast("string"), F.lit(","), (F.col("c.y") + y).cast("string"), F.lit("]"))
    rings = F.concat(F.lit("[["), F.concat_ws(",", *[corner(x, y) for x, y in _HOUSE]), F.lit("]]"))
    shape = lambda kind, what: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), what, F.lit("}"))
    several = F.concat(F.lit("["), F.concat_ws(",", at("c"), F.when(F.col("d").isNotNull(), at("d"))), F.lit("]"))
    twice = F.concat(F.lit("["), rings, F.lit(","), rings, F.lit("]"))
    both = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.concat_ws(",", shape("Polygon", rings), F.when(F.col("d").isNotNull(), shape("Point", at("d")))), F.lit("]}"))
    k = F.col("p_partkey") % 4
    g = F.when(k == 0, shape("Point", at("c"))).when(k == 1, shape("MultiPoint", several)).when(k == 2, shape("MultiPolygon", twice)).otherwise(both)
    kind = F.get(F.array(*map(F.lit, ("point", "points", "polygons", "collection"))), k.cast("int"))
    return c.select("p_partkey", kind.alias("kind"), F.explode(X.geometry_cells(g, RES)).alias("cell"))


_EVERY_CORNER = _geo("hexes", "(SELECT t, ra, rb, cell, s.k AS k FROM every, range(6) s(k))", f"({_X.format(a='ra', b='rb')} + cos(radians(30 + 60 * k)) * {1 / math.sqrt(3)!r})", f"({_Y.format(b='rb')} + sin(radians(30 + 60 * k)) * {1 / math.sqrt(3)!r})")


def _outside_house() -> str:
    """Whether one side of the pentagon has all of a hexagon's corners beyond it."""
    sides = [f"bool_and({x1 - x0!r} * (h.lat - c.lat - {y0!r}) - {y1 - y0!r} * (h.lon - c.lon - {x0!r}) < 0)" for (x0, y0), (x1, y1) in zip(_HOUSE, _HOUSE[1:] + _HOUSE[:1], strict=True)]
    return "(" + " OR ".join(sides) + ")"


def _outside_hexagon() -> str:
    """Whether a side of the hexagon has all of the pentagon's corners beyond it."""
    corners = [f"((w.lon - h.lon) * (c.lat + {y!r} - h.lat) - (w.lat - h.lat) * (c.lon + {x!r} - h.lon) < 0)" for x, y in _HOUSE]
    return "bool_or(" + " AND ".join(corners) + ")"


@query("polyfill_touching", f"""WITH {INNER}, {CENTRES}, {REL}, {_GRID}, {_EVERY_CORNER},
  met AS (SELECT c.p_partkey, c.lon, c.lat, e.t, e.cell FROM centres c JOIN every e ON e.t = c.t AND abs(e.lon - c.lon) < 3 AND abs(e.lat - c.lat) < 3)
  SELECT c.p_partkey, c.cell FROM met c JOIN hexes h ON h.t = c.t AND h.cell = c.cell JOIN hexes w ON w.t = h.t AND w.cell = h.cell AND w.k = (h.k + 1) % 6
  GROUP BY c.p_partkey, c.cell HAVING NOT {_outside_house()} AND NOT {_outside_hexagon()}""")
def polyfill_touching(spark, sf):
    """Cells that share a point with a pentagon: by SQL those that no side of either separates."""
    p = inner_cells(spark, sf).select("p_partkey", X.to_lonlat("cell").alias("c"))
    ring = F.array(*[F.struct((F.col("c.x") + x).alias("x"), (F.col("c.y") + y).alias("y")) for x, y in _HOUSE])
    return FR.polygon_cells(p.select("p_partkey", F.array(ring).alias("p")), "p", RES, touching=True).drop("p")


@query("line_cells", f"WITH {INNER}, {_PAIRED} SELECT p_partkey, k + 1 AS cells, cell AS first, other AS last FROM pairs")
def line_cells(spark, sf):
    """A line between two centres is as long as the distance of their cells."""
    p = _pairs(spark, sf).select("p_partkey", X.line_cells(F.array(X.to_lonlat("cell"), X.to_lonlat("other")), RES).alias("l"))
    return p.select("p_partkey", F.size("l").alias("cells"), F.element_at("l", 1).alias("first"), F.element_at("l", -1).alias("last"))


# ---- clusters, neighbours' values ----------------------------------------------------------------------------------

_OWN = "own AS (SELECT t, a, b, cell, min(p_size) AS size, min(p_size) % 3 AS kind FROM here GROUP BY ALL)"


def _clusters_sql(same: str) -> str:
    step = _APART.format(a="x.a", b="x.b", c="y.a", d="y.b")
    return f"""WITH RECURSIVE {INNER}, {_OWN}, links AS (SELECT x.cell AS u, y.cell AS v FROM own x JOIN own y ON x.t = y.t AND {step} = 1 AND {same}),
      reach AS (SELECT cell AS id, cell AS low FROM own UNION SELECT v, low FROM reach JOIN links ON u = id WHERE low < v)"""


@query("cell_clusters", f"{_clusters_sql('TRUE')} SELECT id AS cell, min(low) AS component FROM reach GROUP BY id")
def cell_clusters(spark, sf):
    return FR.flat_clusters(inner_cells(spark, sf), "cell")


@query("cell_clusters_eq_value", f"{_clusters_sql('x.kind = y.kind')}, label AS (SELECT id, min(low) AS component FROM reach GROUP BY id) SELECT own.cell, CAST(own.kind AS INTEGER) AS kind, component FROM own JOIN label ON id = cell")
def cell_clusters_eq_value(spark, sf):
    one = inner_cells(spark, sf).groupBy("cell").agg((F.min("p_size") % 3).cast("int").alias("kind"))
    return FR.flat_clusters(one, "cell", "kind")


@query("numbered_clusters", f"{_clusters_sql('TRUE')}, label AS (SELECT id, min(low) AS component FROM reach GROUP BY id) SELECT CAST(dense_rank() OVER (ORDER BY component) - 1 AS INTEGER) AS cluster_num, id AS cell FROM label")
def numbered_clusters(spark, sf):
    return FR.clusters(inner_cells(spark, sf), "cell").select("cluster_num", F.explode("cells").alias("cell"))


_VALUES = f"""values_of AS (SELECT x.cell, CAST(x.size AS INTEGER) AS cell_value, {HEAD.replace('[t]', '[x.t]')} | bits AS neighbor_cell, {_APART.format(a='ra', b='rb', c='x.a', d='x.b')} AS k FROM own x JOIN rel ON {_APART.format(a='ra', b='rb', c='x.a', d='x.b')} BETWEEN 1 AND 2)"""


@query("neighbor_values", f"WITH {INNER}, {REL}, {_OWN}, {_VALUES} SELECT v.cell, v.cell_value, v.neighbor_cell, CAST(coalesce(o.size, 0) AS INTEGER) AS neighbor_value, v.k FROM values_of v LEFT JOIN own o ON o.cell = v.neighbor_cell")
def neighbor_values(spark, sf):
    v = inner_cells(spark, sf).groupBy("cell").agg(F.min("p_size").alias("size"))
    return FR.neighbor_values(v.select("cell"), v, "cell", "size", 1, 2, 0)


@query("neighbor_values_known", f"WITH {INNER}, {REL}, {_OWN}, {_VALUES} SELECT v.cell, v.cell_value, v.neighbor_cell, CAST(o.size AS INTEGER) AS neighbor_value, v.k FROM values_of v JOIN own o ON o.cell = v.neighbor_cell")
def neighbor_values_known(spark, sf):
    v = inner_cells(spark, sf).groupBy("cell").agg(F.min("p_size").alias("size"))
    return FR.neighbor_values(v.select("cell"), v, "cell", "size", 1, 2)


# ---- graphs of cells -----------------------------------------------------------------------------------------------

_G = f"""{_OWN}, g AS (SELECT {D.edge('x.cell', _direction('y.a - x.a', 'y.b - x.b'))} AS edge, x.cell AS origin, y.cell AS destination, CAST(x.size + y.size AS BIGINT) AS weight,
  x.t AS t, x.a AS a, x.b AS b, y.a AS a2, y.b AS b2 FROM own x JOIN own y ON x.t = y.t AND {_APART.format(a='x.a', b='x.b', c='y.a', d='y.b')} = 1 AND x.size <= y.size)"""


def _graph(spark, sf) -> DataFrame:
    """Edges between neighbouring cells, from the one with the smaller value to the other."""
    v = inner_cells(spark, sf).groupBy("cell").agg(F.min("p_size").cast("long").alias("size"))
    near = v.select(F.col("cell").alias("a"), F.col("size").alias("s"), F.explode(X.grid_ring("cell", 1)).alias("b"))
    pairs = near.join(v.select(F.col("cell").alias("b"), F.col("size").alias("z")), "b").filter("s <= z")
    return GR.from_cells(pairs.withColumn("w", F.col("s") + F.col("z")), "a", "b", "w")


@query("graph_from_cells", f"WITH {INNER}, {_G} SELECT edge, origin, destination, weight FROM g")
def graph_from_cells(spark, sf):
    return _graph(spark, sf)


@query("graph_bidirectional", f"WITH {INNER}, {_G}, two AS (SELECT origin, destination, weight FROM g UNION ALL SELECT destination, origin, weight FROM g) SELECT origin, destination, min(weight) AS weight FROM two GROUP BY ALL")
def graph_bidirectional(spark, sf):
    return GR.from_cells(_graph(spark, sf), "origin", "destination", "weight", bidirectional=True).select("origin", "destination", "weight")


_UP = _place("cell", 0, 3), _place("cell", 1, 3)


@query("graph_downsample", f"""WITH {INNER}, {_G}, up AS (SELECT {D.parent('origin', 3)} AS o, {D.parent('destination', 3)} AS d, weight FROM g),
  ab AS (SELECT o, d, min(weight) AS weight FROM up WHERE o <> d GROUP BY ALL),
  dir AS (SELECT *, {_place('d', 0, 3)} - {_place('o', 0, 3)} AS da, {_place('d', 1, 3)} - {_place('o', 1, 3)} AS db FROM ab)
  SELECT {D.edge('o', _direction('da', 'db'))} AS edge, o AS origin, d AS destination, weight FROM dir""")
def graph_downsample(spark, sf):
    return GR.downsample(_graph(spark, sf), 3)


@query("graph_nearest_nodes", f"""WITH {INNER}, {_G}, nodes AS (SELECT t, cell, a, b, bit_or(kind) AS node_type FROM (SELECT t, origin AS cell, a, b, 1 AS kind FROM g UNION ALL SELECT t, destination, a2, b2, 2 FROM g) GROUP BY ALL),
  met AS (SELECT own.cell, n.cell AS node, n.node_type, {_APART.format(a='own.a', b='own.b', c='n.a', d='n.b')} AS k FROM own JOIN nodes n ON n.t = own.t AND {_APART.format(a='own.a', b='own.b', c='n.a', d='n.b')} <= 2)
  SELECT cell, node, CAST(node_type AS INTEGER) AS node_type, k FROM met QUALIFY k = min(k) OVER (PARTITION BY cell)""")
def graph_nearest_nodes(spark, sf):
    out = GR.nearest_nodes(inner_cells(spark, sf), "cell", GR.nodes(_graph(spark, sf)), 2)
    return out.select("cell", "node", F.col("node_type").cast("int").alias("node_type"), "k")


@query("graph_edges_of_nodes", f"WITH {INNER}, {_G}, pick AS (SELECT min(origin) AS c, min(edge) AS e FROM g) SELECT 'from' AS what, edge, weight FROM g, pick WHERE origin = c UNION ALL SELECT 'to', edge, weight FROM g, pick WHERE destination = c UNION ALL SELECT 'own', edge, weight FROM g, pick WHERE edge = e")
def graph_edges_of_nodes(spark, sf):
    g = _graph(spark, sf)
    c, e = g.agg(F.min("origin"), F.min("edge")).first()
    show = lambda df, what: df.select(F.lit(what).alias("what"), F.col("edge") if "edge" in df.columns else F.lit(e).alias("edge"), "weight")
    return show(GR.edges_from(g, c), "from").unionByName(show(GR.edges_to(g, c), "to")).unionByName(show(GR.edge_weight(g, e), "own"))


@query("graph_bounds", f"WITH {INNER}, {CENTRES}, {_G}, n AS (SELECT origin AS cell FROM g UNION SELECT destination FROM g) SELECT round(min(lon), 7) AS x0, round(min(lat), 7) AS y0, round(max(lon), 7) AS x1, round(max(lat), 7) AS y1 FROM centres WHERE cell IN (SELECT cell FROM n)")
def graph_bounds(spark, sf):
    return GR.bounding_rect(_graph(spark, sf)).select(*[F.round(c, 7).alias(c) for c in ("x0", "y0", "x1", "y1")])


_WALK = """walk(origin, cell, cost, hops) AS (SELECT DISTINCT origin, origin, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM g WHERE origin IN (SELECT origin FROM starts)
  UNION SELECT w.origin, g.destination, w.cost + g.weight, w.hops + 1 FROM walk w JOIN g ON g.origin = w.cell WHERE w.cost + g.weight <= 150)"""


@query("graph_routes", f"""WITH RECURSIVE {INNER}, {_G}, starts AS (SELECT origin FROM g WHERE origin % 5 = 0), {_WALK}
  SELECT origin, cell AS destination, CAST(min(cost) AS DOUBLE) AS cost, TRUE AS sound FROM walk WHERE cell IN (SELECT destination FROM g) AND cell % 7 < 3 GROUP BY ALL""")
def graph_routes(spark, sf):
    """Paths of ``shortest_paths`` between all cells of two kinds, with the check that their edges lead from one end to the
    other at the stated cost. (The weights of a path grow, so none costs more than the SQL follows.)"""
    g = _graph(spark, sf)
    starts = g.filter("origin % 5 = 0").select(F.col("origin").alias("c")).distinct()
    ends = g.filter("destination % 7 < 3").select(F.col("destination").alias("c")).distinct()
    paths = RO.path_cells(RO.shortest_paths(g, starts, "c", ends, "c")).filter("cost <= 150")
    ends = ["origin", "destination"]
    costs = paths.select(*ends, F.explode("edges").alias("edge")).join(g.select("edge", "weight"), "edge").groupBy(*ends).agg(F.sum("weight").alias("total"))
    sound = (F.element_at("cells", 1) == F.col("origin")) & (F.element_at("cells", -1) == F.col("destination")) & (F.size("cells") == F.size("edges") + 1) & (F.coalesce("total", F.lit(0)) == F.col("cost"))
    return paths.join(costs, ends, "left").select(*ends, "cost", sound.alias("sound"))


@query("path_lengths", f"""WITH {INNER}, {CORNERS}, {SIDES}, {_G}, m AS (SELECT DISTINCT {D.edge('cell', 'd')} AS edge, rads * 6371007.180918475 AS m FROM sides)
  SELECT g.edge, round(min(m.m), 3) AS length_m, 2 AS cells FROM g JOIN m ON m.edge = g.edge GROUP BY g.edge""")
def path_lengths(spark, sf):
    paths = _graph(spark, sf).select("origin", "destination", F.col("weight").cast("double").alias("cost"), F.array("edge").alias("edges"))
    out = RO.path_cells(RO.path_lengths(paths))
    return out.select(F.col("edges")[0].alias("edge"), F.round("length_m", 3).alias("length_m"), F.size("cells").alias("cells"))


@query("graph_differential", f"""WITH RECURSIVE {INNER}, {_G}, starts AS (SELECT origin FROM g WHERE origin % 5 = 0), gone AS (SELECT origin AS c FROM g WHERE origin % 11 = 3),
  h AS (SELECT * FROM g WHERE origin NOT IN (SELECT c FROM gone) AND destination NOT IN (SELECT c FROM gone)),
  {_WALK}, {_WALK.replace('walk', 'after').replace('FROM g ', 'FROM h ').replace('JOIN g ', 'JOIN h ').replace('g.', 'h.')},
  ends AS (SELECT destination AS c FROM g WHERE destination % 7 < 3),
  x AS (SELECT origin, count(*) AS before, sum(cost) AS before_cost FROM (SELECT origin, cell, min(cost) AS cost FROM walk WHERE cell IN (SELECT c FROM ends) GROUP BY ALL) GROUP BY origin),
  y AS (SELECT origin, count(*) AS after, sum(cost) AS after_cost FROM (SELECT origin, cell, min(cost) AS cost FROM after WHERE cell IN (SELECT c FROM ends) AND cell IN (SELECT destination FROM h UNION SELECT origin FROM h) GROUP BY ALL) GROUP BY origin)
  SELECT origin, before, CAST(before_cost AS DOUBLE) AS before_cost, coalesce(after, 0) AS after, CAST(coalesce(after_cost, 0) AS DOUBLE) AS after_cost FROM x LEFT JOIN y USING (origin)""")
def graph_differential(spark, sf):
    """Number and cost of each origin's paths with the whole graph, and without every eleventh cell."""
    g = _graph(spark, sf)
    starts = g.filter("origin % 5 = 0").select(F.col("origin").alias("c")).distinct()
    ends = g.filter("destination % 7 < 3").select(F.col("destination").alias("c")).distinct()
    gone = g.filter("origin % 11 = 3").select(F.col("origin").alias("c")).distinct()
    d = RO.differential(g, starts, "c", ends, "c", gone, "c")
    some = lambda c: F.filter(c, lambda p: p["cost"] <= 150)
    total = lambda c: F.aggregate(some(c), F.lit(0.0), lambda s, p: s + p["cost"])
    d = d.select("origin", F.size(some("before")).cast("long").alias("before"), total("before").alias("before_cost"), F.size(some("after")).cast("long").alias("after"), total("after").alias("after_cost"))
    return d.filter("before > 0")


_ROW = f"""row_of AS (SELECT t, {HEAD} | bits AS cell, ra FROM rel, range(1, {len(_AT_CENTRE) + 1}) s(t) WHERE rb = 0 AND ra BETWEEN -4 AND 4)"""


@query("graph_long_edges", f"""WITH {REL}, {_ROW}, n AS (SELECT count(*) % 7 + 1 AS w FROM part) SELECT {D.edge('x.cell', '4')} AS edge, 8 AS edges, 8.0 * w AS weight, y.cell AS destination FROM row_of x JOIN row_of y ON x.t = y.t AND x.ra = -4 AND y.ra = 4, n""")
def graph_long_edges(spark, sf):
    """Straight rows of nine cells through the face centres are one long edge each, from their first edge."""
    w = I.table(spark, sf, "part").count() % 7 + 1
    c = spark.createDataFrame([(b,) for b in _AT_CENTRE], "b int").select(F.col("b").alias("seq"), B.center_child(B.base_id(F.col("b")), RES).alias("c"))
    end = lambda i: X.from_local_ij("c", F.struct(F.lit(i).alias("i"), F.lit(0).alias("j")))
    cells = c.select("seq", F.posexplode(X.grid_path(end(-4), end(4))).alias("p", "cell"))
    edges = FR.cells_to_edges(cells, "cell", "p", ["seq"]).withColumn("weight", F.lit(w))
    g = GR.prepare(GR.from_edges(edges)).filter("longedge IS NOT NULL")
    return g.select("edge", F.size("longedge.path").alias("edges"), F.col("longedge.weight").cast("double").alias("weight"), "longedge.destination")


# ---- scalar functions ----------------------------------------------------------------------------------------------


@query("resolution_averages", f"SELECT r_regionkey, {_list([4.357449416078383e6, 6.097884417941332e5, 8.680178039899720e4, 1.239343465508816e4, 1.770347654491307e3])}[r_regionkey + 1] AS km2, {_list([1281.256011, 483.0568391, 182.5129565, 68.97922179, 26.07175968])}[r_regionkey + 1] AS km, round({_list([4357449416078.383, 609788441794.1332, 86801780398.9972, 12393434655.08816, 1770347654.491307])}[r_regionkey + 1], 1) AS m2, round({_list([1281256.011, 483056.8391, 182512.9565, 68979.22179, 26071.75968])}[r_regionkey + 1] * sqrt(3.0), 4) AS centres_m FROM region")
def resolution_averages(spark, sf):
    r = F.col("r_regionkey")
    return I.table(spark, sf, "region").select("r_regionkey", B.area_avg_km2(r).alias("km2"), B.edge_length_avg_km(r).alias("km"), F.round(B.area_avg_m2(r), 1).alias("m2"), F.round(B.centroid_distance_avg_m(r), 4).alias("centres_m"))


@query("parse_triples", "SELECT c_custkey, round((c_custkey * 7919 % 36000) / 100.0 - 180.0, 2) AS x, round((c_custkey * 104729 % 17000) / 100.0 - 85.0, 2) AS y, CAST(c_custkey % 16 AS INTEGER) AS res FROM customer")
def parse_triples(spark, sf):
    c = I.customer_points(spark, sf).withColumn("s", F.concat_ws(",", F.format_string("%.2f", "lon"), F.format_string("%.2f", "lat"), (F.col("c_custkey") % 16).cast("string")))
    t = B.parse_triple("s")
    return c.select("c_custkey", F.round(t["x"], 2).alias("x"), F.round(t["y"], 2).alias("y"), t["res"].alias("res"))


@query("edge_strings", f"WITH {INNER} SELECT p_partkey, {D.edge('cell', '2')} AS edge, CASE WHEN p_partkey % 2 = 0 THEN {D.edge('cell', '2')} END AS some, CAST(2 AS INTEGER) AS direction FROM here")
def edge_strings(spark, sf):
    e = inner_cells(spark, sf).withColumn("e", F.get(B.outgoing_edges("cell"), F.lit(1)))
    broken = F.when(F.col("p_partkey") % 2 == 0, B.to_hex("e")).otherwise(F.concat(B.to_hex("e"), F.lit("x")))
    return e.select("p_partkey", B.from_hex(B.to_hex("e"), "edge").alias("edge"), B.from_hex(broken, "edge").alias("some"), B.edge_direction("e").alias("direction"))


@query("cell_strings", f"WITH {INNER} SELECT p_partkey, cell AS hex, cell AS number, NULL::BIGINT AS neither FROM here")
def cell_strings(spark, sf):
    c = inner_cells(spark, sf)
    return c.select("p_partkey", B.from_string(B.to_hex("cell")).alias("hex"), B.from_string(F.col("cell").cast("string")).alias("number"), B.from_string(F.lit("no cell")).alias("neither"))


@query("try_cells", f"WITH {I.MIXED_IDS} SELECT l_orderkey, l_linenumber, CASE WHEN {D.valid('cell')} THEN cell END AS cell, CASE WHEN {D.valid('cell')} THEN {D.res('cell')} % 2 = 1 END AS class_iii FROM ids")
def try_cells(spark, sf):
    ids = I.mixed_ids(spark, sf).select("l_orderkey", "l_linenumber", B.try_cell("cell").alias("cell"))
    return ids.withColumn("class_iii", B.is_class_iii("cell"))


@query("child_from_pos", f"WITH {I.part_cells_sql()} SELECT p_partkey, {D.children('cell', 3, 5)}[p_partkey % 49 + 1] AS child, p_partkey % 49 AS back FROM cells")
def child_from_pos(spark, sf):
    c = I.part_cells(spark, sf).withColumn("child", B.child_from_pos("cell", 5, F.col("p_partkey") % 49))
    return c.select("p_partkey", "child", B.child_pos("child", 3).alias("back"))


@query("digits_as_directions", f"WITH {INNER} SELECT p_partkey, {D.digit('cell', '4')} AS own, {D.digit('cell', '3')} AS above, CASE WHEN p_size % 10 < 7 THEN CAST(p_size % 10 AS INTEGER) END AS number FROM here")
def digits_as_directions(spark, sf):
    c = inner_cells(spark, sf)
    return c.select("p_partkey", B.direction_at("cell", 4).cast("int").alias("own"), B.direction_to_parent("cell").cast("int").alias("above"), B.direction_from_number(F.col("p_size") % 10).cast("int").alias("number"))


# ---- sets ----------------------------------------------------------------------------------------------------------

_MIXED = f"{I.part_cells_sql()}, two AS (SELECT cell FROM cells WHERE p_size > 20 UNION SELECT {D.parent('cell', 2)} FROM cells WHERE p_size <= 20)"


def _mixed(spark, sf) -> DataFrame:
    c = I.part_cells(spark, sf)
    return CO.union(c.filter("p_size > 20").select("cell"), c.filter("p_size <= 20").select(B.parent("cell", 2).alias("cell")), "cell")


@query("set_union", f"WITH {_MIXED} SELECT cell FROM two")
def set_union(spark, sf):
    return _mixed(spark, sf)


@query("set_finest", f"WITH {_MIXED} SELECT CAST(max({D.res('cell')}) AS INTEGER) AS finest, count(*) AS cells, count(*) = 0 AS empty FROM two")
def set_finest(spark, sf):
    two = _mixed(spark, sf)
    return CO.finest_resolution(two, "cell").select(F.col("finest").cast("int").alias("finest")).crossJoin(two.agg(F.count("*").alias("cells"), (F.count("*") == 0).alias("empty")))  # one row each


@query("set_without_covered", f"WITH {_MIXED} SELECT cell FROM two t WHERE {D.res('cell')} < 3 OR {D.parent('cell', 2)} NOT IN (SELECT cell FROM two)")
def set_without_covered(spark, sf):
    return FR.purge_covered(_mixed(spark, sf), "cell", [])


@query("block_members", f"WITH {I.part_cells_sql()}, s AS (SELECT DISTINCT p_size, cell FROM cells), low AS (SELECT min(cell) AS m FROM cells) SELECT p_size, 8 * count(*) AS plain, bool_or(cell = m) AS has_least FROM s, low GROUP BY p_size")
def block_members(spark, sf):
    c = I.part_cells(spark, sf)
    low = c.agg(F.min("cell")).first()[0]
    b = c.groupBy("p_size").agg(CO.pack(F.array_sort(F.collect_set("cell"))).alias("block"))
    return b.select("p_size", CO.block_sizes("block")["plain"].cast("long").alias("plain"), CO.block_contains("block", F.lit(low)).alias("has_least"))


# ---- transforms ----------------------------------------------------------------------------------------------------


@query("affine_kinds", f"WITH {I.CUSTOMER_POINTS} SELECT c_custkey, round(lon * 0.5 + lat * 0.25 - 180, 6) AS x, round(lon * 0.125 - lat * 0.5 + 85, 6) AS y, round(lon, 6) AS back_x, round(lat, 6) AS back_y, -0.28125 AS determinant FROM points")
def affine_kinds(spark, sf):
    t = RA.Transform.from_gdal((-180.0, 0.5, 0.25, 85.0, 0.125, -0.5))
    assert t == RA.Transform.from_rasterio((0.5, 0.25, -180.0, 0.125, -0.5, 85.0)) and not t.is_degenerate()
    p = I.customer_points(spark, sf)
    x, y = t.columns("lon", "lat")
    p = p.withColumn("x", x).withColumn("y", y)
    bx, by = t.invert().columns("x", "y")
    return p.select("c_custkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(bx, 6).alias("back_x"), F.round(by, 6).alias("back_y"), F.lit(t.determinant()).alias("determinant"))
