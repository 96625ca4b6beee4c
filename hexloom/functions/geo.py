"""Cell functions that need the grid's geometry, as vectorised Arrow functions over the NumPy kernel.

Each takes Columns (or names) and plain parameters. Null or invalid input gives null. Coordinates are degrees, x the
longitude; a polygon is an array of rings, a ring an array of struct<x, y>.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from hexloom.functions.bits import col
from hexloom.kernel import cells as C
from hexloom.kernel import geometry as Q
from hexloom.kernel import grid as G
from hexloom.kernel import polygons as P
from hexloom.kernel import shapes as S
from hexloom.kernel import vertexes as V

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
POLYGON = f"array<{RING}>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def _cells(a: pa.Array, valid: Callable = G.is_valid) -> tuple[np.ndarray, np.ndarray]:
    """Ids and which of them are valid."""
    h = a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return h, valid(h)


def _scatter(n: int, at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    out = np.zeros(n, values.dtype)
    out[at] = values
    mask = np.ones(n, bool)
    mask[at] = False
    return pa.array(out, kind, mask=mask)


def _lists(n: int, at: np.ndarray, sizes: np.ndarray, values: pa.Array) -> pa.Array:
    """A list array with nulls outside ``at``."""
    length = np.zeros(n, np.int64)
    length[at] = sizes
    null = np.ones(n, bool)
    null[at] = False
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(null))


def _points(xy: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(_POINT))


def _rings(items: list, depth: int) -> pa.Array:
    """Nested lists of arrays of points, ``depth`` deep; None is null."""
    flat = [x for x in items if x is not None]
    size = np.array([len(x) for x in flat], np.int64)
    if depth > 1:
        values = _rings([y for x in flat for y in x], depth - 1)
    else:
        values = _points(np.concatenate([np.asarray(x, float).reshape(-1, 2) for x in flat]) if flat else np.zeros((0, 2)))
    return _lists(len(items), np.array([k for k, x in enumerate(items) if x is not None], np.int64), size, values)


@lru_cache(maxsize=None)
def _udf(name: str, kind: str, *parameters) -> Callable:
    """The Arrow function ``name`` of this module with its plain parameters bound."""
    body = globals()["_" + name]

    def run(*arrays: pa.Array) -> pa.Array:
        return body(*arrays, *parameters)

    return F.arrow_udf(_fixed(run, _ARITY[name]), kind)


def _fixed(run: Callable, n: int) -> Callable:
    """A function with ``n`` Arrow arguments, which Spark wants to see in the signature."""

    def one(a: pa.Array) -> pa.Array:
        return run(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    def three(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
        return run(a, b, c)

    return (one, two, three)[n - 1]


_ARITY = dict(from_lonlat=2, from_lonlat_at=3, to_lonlat=1, boundary=1, area=1, disk=1, disk_distances=1, ring=1, distance=2, neighbors=2, edge_to=2, edge_destination=1, edge_destinations=1, edge_lengths=1, centres=1, edge_reversed=1, edge_boundary=1, edge_length=1, path=2, unbroken=1, line=1, local_ij=2, from_local_ij=2, polygon_cells=1, polygon_cells_touching=1, polygon_cells_around=1, touches=1, geometry_cells=1, contains_point=2, inside=2, envelope=1, dissolve=1, smooth=1, aligned=1, covered=1, vertexes=1, vertex_ids=1, vertex_to_lonlat=1, valid_vertex=1, max_polygon_cells=1, faces=1)


def from_lonlat(lon: Column | str, lat: Column | str, res: int) -> Column:
    """The cell at ``res`` that holds a point."""
    if not 0 <= res <= 15:
        raise ValueError(f"resolution {res} is not between 0 and 15")
    return _udf("from_lonlat", "bigint", res)(col(lon).cast("double"), col(lat).cast("double"))


def _from_lonlat(lon, lat, res):
    x, y = (a.fill_null(float("nan")).to_numpy(zero_copy_only=False) for a in (lon, lat))
    h = G.from_lonlat(x, y, res)
    return pa.array(h, pa.int64(), mask=h == 0)


def from_lonlat_at(lon: Column | str, lat: Column | str, res: Column | str) -> Column:
    """The cell that holds a point, at a resolution from a column."""
    return _udf("from_lonlat_at", "bigint")(col(lon).cast("double"), col(lat).cast("double"), col(res).cast("int"))


def _from_lonlat_at(lon, lat, res):
    x, y = (a.fill_null(float("nan")).to_numpy(zero_copy_only=False) for a in (lon, lat))
    r = res.fill_null(-1).to_numpy(zero_copy_only=False)
    out = np.zeros(len(x), np.int64)
    for k in range(16):
        at = np.flatnonzero(r == k)
        if len(at):
            out[at] = G.from_lonlat(x[at], y[at], k)
    return pa.array(out, pa.int64(), mask=out == 0)


def to_lonlat(c: Column | str) -> Column:
    """A cell's centre as struct<x, y>."""
    return _udf("to_lonlat", POINT)(col(c))


def _to_lonlat(c):
    h, good = _cells(c)
    xy = np.zeros((len(h), 2))
    xy[good, 0], xy[good, 1] = G.to_lonlat(h[good])
    return pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(_POINT), mask=pa.array(~good))


def boundary(c: Column | str, close: bool = True) -> Column:
    """A cell's vertices as a ring, closed unless told otherwise."""
    return _udf("boundary", RING, close)(col(c))


def _boundary(c, close):
    h, good = _cells(c)
    at = np.flatnonzero(good)
    rings = [S.closed(r) if close else r for r in G.boundary(h[at])]
    xy = np.concatenate(rings) if rings else np.zeros((0, 2))
    return _lists(len(h), at, np.array([len(r) for r in rings], np.int64), _points(xy))


def area_rads2(c: Column | str) -> Column:
    return _udf("area", "double")(col(c))


def area_km2(c: Column | str) -> Column:
    return area_rads2(c) * G.EARTH_KM**2


def area_m2(c: Column | str) -> Column:
    return area_km2(c) * 1e6


def _area(c):
    h, good = _cells(c)
    at = np.flatnonzero(good)
    return _scatter(len(h), at, C.areas_rads2(h[at]) if len(at) else np.zeros(0), pa.float64())


def grid_disk(c: Column | str, k: int) -> Column:
    """All cells within ``k`` steps."""
    return _udf("disk", "array<bigint>", k)(col(c))


def _disk(c, k):
    h, good = _cells(c)
    at = np.flatnonzero(good)
    o, cells, _ = G.disk_distances(h[at], k)
    return _lists(len(h), at, np.bincount(o, minlength=len(at)), pa.array(cells))


def grid_disk_distances(c: Column | str, k_min: int, k_max: int) -> Column:
    """All cells from ``k_min`` to ``k_max`` steps away, as array<struct<k, cell>>."""
    return _udf("disk_distances", "array<struct<k:int,cell:bigint>>", k_min, k_max)(col(c))


def _disk_distances(c, k_min, k_max):
    h, good = _cells(c)
    at = np.flatnonzero(good)
    o, cells, d = G.disk_distances(h[at], k_max, k_min)
    pairs = pa.StructArray.from_arrays([pa.array(d.astype(np.int32)), pa.array(cells)], names=["k", "cell"])
    return _lists(len(h), at, np.bincount(o, minlength=len(at)), pairs)


def grid_ring(c: Column | str, k: int, strict: bool = False) -> Column:
    """The cells exactly ``k`` steps away; with ``strict`` null where a pentagon leaves fewer than 6 k of them."""
    return _udf("ring", "array<bigint>", k, strict)(col(c))


def _ring(c, k, strict):
    h, good = _cells(c)
    at = np.flatnonzero(good)
    o, cells, _ = G.disk_distances(h[at], k, k)
    n = np.bincount(o, minlength=len(at))
    if strict and k:
        fine = n == 6 * k
        cells = cells[fine[o]]
        at, n = at[fine], n[fine]
    return _lists(len(h), at, n, pa.array(cells))


def grid_distance(a: Column | str, b: Column | str) -> Column:
    """Steps between two cells of one resolution; null where it can't be computed."""
    return _udf("distance", "int")(col(a), col(b))


def _distance(a, b):
    (x, gx), (y, gy) = _cells(a), _cells(b)
    at = np.flatnonzero(gx & gy)
    d = C.distances(x[at], y[at])
    return _scatter(len(x), at[d >= 0], d[d >= 0].astype(np.int32), pa.int32())


def are_neighbors(a: Column | str, b: Column | str) -> Column:
    """Whether two cells of one resolution share an edge; null across resolutions."""
    return _udf("neighbors", "boolean")(col(a), col(b))


def _neighbors(a, b):
    (x, gx), (y, gy) = _cells(a), _cells(b)
    at = np.flatnonzero(gx & gy & (G.resolution(x) == G.resolution(y)))
    uniq, which = np.unique(x[at], return_inverse=True)
    return _scatter(len(x), at, (G.neighbors(uniq)[which] == y[at, None]).any(axis=1) if len(at) else np.zeros(0, bool), pa.bool_())


def directed_edge(a: Column | str, b: Column | str) -> Column:
    """The edge from a cell to its neighbour; null where they aren't neighbours."""
    return _udf("edge_to", "bigint")(col(a), col(b))


def _edge_to(a, b):
    (x, gx), (y, gy) = _cells(a), _cells(b)
    at = np.flatnonzero(gx & gy)
    e = C.edge_to(x[at], y[at])
    return _scatter(len(x), at[e != 0], e[e != 0], pa.int64())


def edge_destination(e: Column | str) -> Column:
    return _udf("edge_destination", "bigint")(col(e))


def _edge_destination(e):
    h, good = _cells(e, C.is_valid_edge)
    at = np.flatnonzero(good)
    return _scatter(len(h), at, C.edge_destination(h[at]), pa.int64())


def _inside_lists(a: pa.Array, of: Callable) -> pa.Array:
    """A list array with ``of`` applied to all elements at once; null lists stay null."""
    size = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), of(a.flatten()), mask=a.is_null())


def edge_destinations(edges: Column | str) -> Column:
    """The destinations of an array of edges."""
    return _udf("edge_destinations", "array<bigint>")(col(edges))


def _edge_destinations(edges):
    return _inside_lists(edges, _edge_destination)


def edge_lengths_m(edges: Column | str) -> Column:
    """The lengths of an array of edges."""
    return F.transform(_udf("edge_lengths", "array<double>")(col(edges)), lambda x: x * G.EARTH_KM * 1000.0)


def _edge_lengths(edges):
    return _inside_lists(edges, _edge_length)


def centres(cells: Column | str) -> Column:
    """The centres of an array of cells, as a line."""
    return _udf("centres", RING)(col(cells))


def _centres(cells):
    return _inside_lists(cells, _to_lonlat)


def edge_reversed(e: Column | str) -> Column:
    return _udf("edge_reversed", "bigint")(col(e))


def _edge_reversed(e):
    h, good = _cells(e, C.is_valid_edge)
    at = np.flatnonzero(good)
    return _scatter(len(h), at, C.edge_reversed(h[at]), pa.int64())


def edge_cells(e: Column | str) -> Column:
    """struct<origin, destination> of an edge."""
    from hexloom.functions.bits import edge_origin, is_valid_edge

    return F.when(is_valid_edge(e), F.struct(edge_origin(e).alias("origin"), edge_destination(e).alias("destination")))


def edge_boundary(e: Column | str) -> Column:
    """The line that the edge's cells share."""
    return _udf("edge_boundary", RING)(col(e))


def _edge_boundary(e):
    h, good = _cells(e, C.is_valid_edge)
    at = np.flatnonzero(good)
    n, xy = C.edge_boundaries(h[at])
    return _lists(len(h), at, n, _points(xy))


def edge_length_rads(e: Column | str) -> Column:
    return _udf("edge_length", "double")(col(e))


def edge_length_km(e: Column | str) -> Column:
    return edge_length_rads(e) * G.EARTH_KM


def edge_length_m(e: Column | str) -> Column:
    return edge_length_km(e) * 1000.0


def centroid_distance_m(e: Column | str) -> Column:
    """Approximate distance of an edge's centres: its length times the square root of 3."""
    return edge_length_m(e) * float(np.sqrt(3))


def _edge_length(e):
    h, good = _cells(e, C.is_valid_edge)
    at = np.flatnonzero(good)
    return _scatter(len(h), at, C.edge_lengths_rads(h[at]) if len(at) else np.zeros(0), pa.float64())


def edge_line(e: Column | str) -> Column:
    """The line from the origin's centre to the destination's."""
    from hexloom.functions.bits import edge_origin, is_valid_edge

    return F.when(is_valid_edge(e), F.array(to_lonlat(edge_origin(e)), to_lonlat(edge_destination(e))))


def grid_path(a: Column | str, b: Column | str) -> Column:
    """The cells of the line between two cells; null where it can't be computed."""
    return _udf("path", "array<bigint>")(col(a), col(b))


def _path(a, b):
    (x, gx), (y, gy) = _cells(a), _cells(b)
    at = np.flatnonzero(gx & gy)
    n, cells = C.paths(x[at], y[at])
    return _lists(len(x), at[n > 0], n[n > 0], pa.array(cells))


def unbroken(cells: Column | str) -> Column:
    """Whether each cell of an array, but the last, is a neighbour of the next one."""
    return _udf("unbroken", "boolean")(col(cells))


def _unbroken(cells):
    at = np.flatnonzero(np.asarray(cells.is_valid()))
    size = cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(cells)), size)
    h, good = _cells(cells.flatten())
    go = np.flatnonzero(own[1:] == own[:-1]) if len(own) else np.zeros(0, np.int64)
    near = good[go] & good[go + 1]
    near[near] = C.edge_to(h[go[near]], h[go[near] + 1]) != 0
    return _scatter(len(cells), at, (np.bincount(own[go[~near]], minlength=len(cells)) == 0)[at], pa.bool_())


def line_cells(points: Column | str, res: int) -> Column:
    """Cells along a line (array of struct<x, y>), in order."""
    return _udf("line", "array<bigint>", res)(col(points))


def _line(points, res):
    size = points.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    p = points.flatten()
    x, y = (pc.struct_field(p, k).fill_null(float("nan")).to_numpy(zero_copy_only=False) for k in (0, 1))
    n, cells = C.lines(x, y, size, res)
    at = np.flatnonzero(n)
    return _lists(len(points), at, n[at], pa.array(cells))


def to_local_ij(origin: Column | str, c: Column | str) -> Column:
    """struct<i, j> of a cell in its origin's axes; null where it can't be computed."""
    return _udf("local_ij", "struct<i:int,j:int>")(col(origin), col(c))


def _local_ij(origin, c):
    (o, go), (h, gh) = _cells(origin), _cells(c)
    good = go & gh & (G.resolution(o) == G.resolution(h))
    i, j = np.zeros(len(o), np.int32), np.zeros(len(o), np.int32)
    for res, rows in G.by_resolution(o):
        at = rows[good[rows]]
        a, b, fine = C.local_ij(o[at], h[at], res)
        i[at], j[at] = a, b
        good[at] = fine
    return pa.StructArray.from_arrays([pa.array(i), pa.array(j)], names=["i", "j"], mask=pa.array(~good))


def from_local_ij(origin: Column | str, ij: Column | str) -> Column:
    """The cell at struct<i, j> in its origin's axes."""
    return _udf("from_local_ij", "bigint")(col(origin), col(ij))


def _from_local_ij(origin, ij):
    o, good = _cells(origin)
    good &= ~np.asarray(ij.is_null())
    i, j = (ij.field(k).fill_null(0).to_numpy(zero_copy_only=False) for k in (0, 1))
    out = np.zeros(len(o), np.int64)
    for res, rows in G.by_resolution(o):
        at = rows[good[rows]]
        out[at] = C.from_local_ij(o[at], i[at], j[at], res)
    return pa.array(out, mask=out == 0)


def polygon_cells(polygon: Column | str, res: int) -> Column:
    """Cells whose centres are inside a polygon."""
    return _udf("polygon_cells", "array<bigint>", res)(col(polygon))


def _flat(p: pa.Array) -> tuple[np.ndarray, P.Polygons]:
    """The rows that hold polygons, and these polygons, without a Python object for a point."""
    rows = np.flatnonzero(np.asarray(p.is_valid()))
    outer, rings = p.offsets.to_numpy(), p.values
    inner, points = rings.offsets.to_numpy(), rings.values
    x, y = (points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    size = np.diff(outer)[rows]
    ring = np.repeat(outer[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
    return rows, P.Polygons.of_rings(np.repeat(np.arange(len(rows)), size), inner[ring].astype(np.int64), inner[ring + 1].astype(np.int64), x, y, len(rows))


def _polygon_cells(p, res, touching=False, around=False):
    rows, polygons = _flat(p)
    n, cells = P.cells_of(polygons, res, touching, around)
    return _lists(len(p), rows, n, pa.array(cells))


def polygon_cells_touching(polygon: Column | str, res: int) -> Column:
    """Cells that share a point with a polygon."""
    return _udf("polygon_cells_touching", "array<bigint>", res)(col(polygon))


def _polygon_cells_touching(p, res):
    return _polygon_cells(p, res, True)


def polygon_cells_around(polygon: Column | str, res: int) -> Column:
    """Cells that share a point with a polygon, and their neighbours."""
    return _udf("polygon_cells_around", "array<bigint>", res)(col(polygon))


def _polygon_cells_around(p, res):
    return _polygon_cells(p, res, True, True)


def geometry_cells(g: Column | str, res: int, touching: bool = False, form: str = "geojson") -> Column:
    """Distinct cells of a geometry of any kind (Point to GeometryCollection), from GeoJSON text or, with ``form`` "wkb",
    well-known binary; null for what is no geometry. Collections are the union of their parts."""
    return _udf("geometry_cells", "array<bigint>", res, touching, form)(col(g))


def _geometry_cells(g, res, touching, form):
    read = Q.from_geojson if form == "geojson" else Q.from_wkb
    rows, found = [], []
    for k, x in enumerate(g.to_pylist()):
        try:
            if x is not None:
                found.append(read(x))
                rows.append(k)
        except Q.GeometryInvalid:
            pass
    cells = Q.cells_of(found, res, touching)
    return _lists(len(g), np.array(rows, np.int64), np.array([len(c) for c in cells], np.int64), pa.array(np.concatenate(cells) if cells else np.zeros(0, np.int64)))


def envelope(c: Column | str, kind: str = "cell") -> Column:
    """struct<x0, y0, x1, y1>: the box around a cell's boundary, or around an edge's line."""
    return _udf("envelope", "struct<x0:double,y0:double,x1:double,y1:double>", kind)(col(c))


def _envelope(c, kind):
    h, good = _cells(c, G.is_valid if kind == "cell" else C.is_valid_edge)
    at = np.flatnonzero(good)
    box = np.zeros((len(h), 4))
    if kind == "cell":
        for k, r in zip(at, G.boundary(h[at]), strict=True):
            box[k] = [*r.min(axis=0), *r.max(axis=0)]
    elif len(at):
        a, b = (np.stack(G.to_lonlat(x), axis=1) for x in (C.edge_origin(h[at]), C.edge_destination(h[at])))
        box[at, :2], box[at, 2:] = np.minimum(a, b), np.maximum(a, b)
    return pa.StructArray.from_arrays([pa.array(box[:, k]) for k in range(4)], names=["x0", "y0", "x1", "y1"], mask=pa.array(~good))


def touches(c: Column | str, polygon: list, kind: str = "cell") -> Column:
    """Whether a cell's polygon, or an edge's line, shares a point with a polygon (a list of rings)."""
    return _udf("touches", "boolean", tuple(tuple(map(tuple, r)) for r in polygon), kind)(col(c))


def _touches(c, polygon, kind):
    rings = [np.array(r, float) for r in polygon]
    h, good = _cells(c, G.is_valid if kind == "cell" else C.is_valid_edge)
    at = np.flatnonzero(good)
    if kind == "cell":
        hit = np.array([S.intersects([b], rings) for b in G.boundary(h[at])], bool)
    else:
        a, b = (np.stack(G.to_lonlat(x), axis=1) for x in (C.edge_origin(h[at]), C.edge_destination(h[at])))
        around = S._segments(rings)
        hit = np.array([S.segments_cross(np.concatenate([p, q])[None], around) for p, q in zip(a, b, strict=True)], bool) | S.inside(a, rings)
    return _scatter(len(h), at, hit, pa.bool_())


def contains_point(x: Column | str, y: Column | str, polygon: list) -> Column:
    """Whether a point is inside a polygon (a list of rings)."""
    return _udf("contains_point", "boolean", tuple(tuple(map(tuple, r)) for r in polygon))(col(x), col(y))


def _contains_point(x, y, polygon):
    rings = [np.array(r, float) for r in polygon]
    null = np.asarray(x.is_null()) | np.asarray(y.is_null())
    p = np.stack([a.fill_null(0.0).to_numpy(zero_copy_only=False) for a in (x, y)], axis=1)
    return pa.array(S.inside(p, rings), mask=null)


def inside(point: Column | str, polygon: Column | str) -> Column:
    """Whether a point (struct<x, y>) is inside the polygon of its row."""
    return _udf("inside", "boolean")(col(point), col(polygon))


def _inside(point, polygon):
    rows, polygons = _flat(polygon)
    good = np.asarray(point.is_valid())[rows]
    x, y = (point.field(k).fill_null(0.0).to_numpy(zero_copy_only=False)[rows[good]] for k in (0, 1))
    at = rows[good]
    return _scatter(len(point), at, P.inside(x, y, np.flatnonzero(good), polygons), pa.bool_())


def dissolve(cells: Column | str, smoothen: bool = False) -> Column:
    """Polygons of the union of an array of cells of one resolution."""
    return _udf("dissolve", f"array<{POLYGON}>", smoothen)(col(cells))


def _dissolve(cells, smoothen):
    at = np.flatnonzero(np.asarray(cells.is_valid()))
    own = np.repeat(np.arange(len(cells)), cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    h, good = _cells(cells.flatten())
    d = S.dissolve_all(h[good], own[good], len(cells))
    if smoothen:
        out: list = [None] * len(cells)
        polygons = d.lists()
        for k in at.tolist():
            out[k] = [S.smooth_polygon(p) for p in polygons[k]]
        return _rings(out, 3)
    rings = pa.ListArray.from_arrays(pa.array(d.rings.astype(np.int32)), _points(d.points))
    return _lists(len(cells), at, d.size[at], pa.ListArray.from_arrays(pa.array(d.polygons.astype(np.int32)), rings))


def dissolve_aligned(cells: Column | str, res: int, smoothen: bool = True) -> Column:
    """Polygons by ancestor at ``res``, corners moved onto the ancestor's where they are near."""
    return _udf("aligned", f"array<{POLYGON}>", res, smoothen)(col(cells))


def _aligned(cells, res, smoothen):
    return _rings([None if c is None else S.aligned(np.array([x for x in c if x is not None], np.int64), res, smoothen) for c in cells.to_pylist()], 3)


def covered_area(cells: Column | str, res: int) -> Column:
    """Outlines of the area of an array of cells, coarsened to ``res``."""
    return _udf("covered", f"array<{POLYGON}>", res)(col(cells))


def _covered(cells, res):
    return _rings([None if c is None else S.covered_area(np.array([x for x in c if x is not None], np.int64), res) for c in cells.to_pylist()], 3)


def smooth(ring: Column | str) -> Column:
    """A smoothed line or ring."""
    return _udf("smooth", RING)(col(ring))


def _smooth(ring):
    return _rings([None if r is None else S.smooth(np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2)) for r in ring.to_pylist()], 1)


def vertexes(c: Column | str) -> Column:
    """A cell's topological vertices (5 or 6) as struct<x, y>, without those that only icosahedron edges add."""
    return _udf("vertexes", RING)(col(c))


def _vertexes(c):
    h, good = _cells(c)
    at = np.flatnonzero(good)
    n, rings = V.ring_arrays(h[at])
    return _lists(len(h), at, n, _points(rings[np.arange(6) < n[:, None]]))


def vertex_ids(c: Column | str) -> Column:
    """Ids of a cell's vertices; cells that meet in a vertex name it alike."""
    return _udf("vertex_ids", "array<bigint>")(col(c))


def _vertex_ids(c):
    h, good = _cells(c)
    at = np.flatnonzero(good)
    n, ids = V.id_arrays(h[at])
    return _lists(len(h), at, n, pa.array(ids[ids != 0]))


def vertex_to_lonlat(v: Column | str) -> Column:
    return _udf("vertex_to_lonlat", POINT)(col(v))


def _vertex_to_lonlat(v):
    h, good = _cells(v, V.is_valid)
    xy = np.zeros((len(h), 2))
    xy[good] = V.to_lonlat(h[good])
    return pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(_POINT), mask=pa.array(~good))


def is_valid_vertex(v: Column | str) -> Column:
    return _udf("valid_vertex", "boolean")(col(v))


def _valid_vertex(v):
    _, good = _cells(v, V.is_valid)
    return pa.array(good, mask=np.asarray(v.is_null()))


def max_polygon_cells(polygon: Column | str, res: int) -> Column:
    """An upper estimate of how many cells a polygon has, from its envelope."""
    return _udf("max_polygon_cells", "bigint", res)(col(polygon))


def _max_polygon_cells(p, res):
    rows, q = _flat(p)
    box = np.zeros((4, len(rows)))
    for k, (fold, v) in enumerate(((np.minimum, q.x0), (np.minimum, q.y0), (np.maximum, q.x0), (np.maximum, q.y0))):
        if q.some.any():
            box[k, q.some] = fold.reduceat(v, q.start[:-1][q.some])
    x0, y0, x1, y1 = box
    area = np.radians(x1 - x0) * np.abs(np.sin(np.radians(y1)) - np.sin(np.radians(y0))) * S.EARTH_RADIUS_EQUATOR_M**2 / 1e6
    edge = np.hypot(x1 - x0, y1 - y0) * 111.2 / C.EDGE_KM[res]
    return _scatter(len(p), rows, (np.ceil(2 * area / C.AREA_KM2[res] + 4 * edge) + 12).astype(np.int64), pa.int64())


def icosahedron_faces(c: Column | str) -> Column:
    """The faces of the icosahedron that a cell reaches."""
    return _udf("faces", "array<int>")(col(c))


def _faces(c):
    h, good = _cells(c)
    at = np.flatnonzero(good)
    out: list = [None] * len(h)
    lon, lat = G.to_lonlat(h[at])
    for k, x, y, ring in zip(at.tolist(), lon, lat, G.boundary(h[at]), strict=True):
        middles = (ring + np.roll(ring, -1, axis=0)) / 2
        p = np.vstack([[x, y], *(q * 0.999 + np.array([x, y]) * 0.001 for q in (ring, middles))])
        p3 = G.xyz(np.radians(p[:, 1]), np.radians(p[:, 0]))
        out[k] = sorted(set(np.argmax(p3 @ G._CENTRE.T, axis=1).tolist()))
    return pa.array(out, pa.list_(pa.int32()))


def register_all(spark) -> None:
    """Register the functions without plain parameters for SQL, as ``hex_<name>``."""
    for name, kind in {
        "from_lonlat_at": "bigint", "to_lonlat": POINT, "area": "double", "distance": "int", "neighbors": "boolean", "edge_to": "bigint",
        "edge_destination": "bigint", "edge_reversed": "bigint", "edge_boundary": RING, "edge_length": "double", "path": "array<bigint>",
        "local_ij": "struct<i:int,j:int>", "from_local_ij": "bigint", "smooth": RING, "vertexes": RING, "faces": "array<int>",
    }.items():
        spark.udf.register("hex_" + name, _udf(name, kind))
