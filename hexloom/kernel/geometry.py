"""Geometries of any kind to cells: GeoJSON text and well-known binary as (kind, coordinates), and their cells."""

from __future__ import annotations

import json
import struct

import numpy as np

from hexloom.kernel import cells as C
from hexloom.kernel import grid as G
from hexloom.kernel import polygons as P

KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
Geometry = tuple[str, list]


class GeometryInvalid(ValueError):
    """Text or bytes that are no geometry."""


def from_geojson(text: str) -> Geometry:
    """A geometry, or that of a feature."""
    try:
        return _of_json(json.loads(text))
    except json.JSONDecodeError as e:
        raise GeometryInvalid(str(e)) from e


def _of_json(value) -> Geometry:
    try:
        value = value["geometry"] if value["type"] == "Feature" else value
        if value["type"] == "GeometryCollection":
            return value["type"], [_of_json(g) for g in value["geometries"]]
        if value["type"] not in KINDS.values():
            raise GeometryInvalid(value["type"])
        return value["type"], value["coordinates"]
    except (KeyError, TypeError) as e:
        raise GeometryInvalid(str(e)) from e


def from_wkb(raw: bytes) -> Geometry:
    """A geometry of two, three or four dimensions, of which the first two count."""
    try:
        return _read(raw, 0)[0]
    except (struct.error, KeyError, IndexError) as e:
        raise GeometryInvalid(str(e)) from e


def _read(raw: bytes, at: int) -> tuple[Geometry, int]:
    order = "<" if raw[at] == 1 else ">"
    code = struct.unpack_from(order + "I", raw, at + 1)[0]
    at += 5
    if code & 0x20000000:  # a reference system's number follows
        at += 4
    extra = bool(code & 0x80000000) + bool(code & 0x40000000) + (0, 1, 1, 2)[(code & 0xFFFF) // 1000]
    kind, width = KINDS[(code & 0xFFFF) % 1000], 2 + extra

    def count() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", raw, at - 4)[0]

    def points(n: int) -> list:
        nonlocal at
        v = struct.unpack_from(f"{order}{n * width}d", raw, at)
        at += 8 * n * width
        return [list(v[k : k + 2]) for k in range(0, n * width, width)]

    if kind == "Point":
        return (kind, points(1)[0]), at
    if kind == "LineString":
        return (kind, points(count())), at
    if kind == "Polygon":
        return (kind, [points(count()) for _ in range(count())]), at
    parts = []
    for _ in range(count()):
        part, at = _read(raw, at)
        parts.append(part if kind == "GeometryCollection" else part[1])
    return (kind, parts), at


def to_wkb(g: Geometry) -> bytes:
    kind, value = g
    code = next(k for k, v in KINDS.items() if v == kind)
    head = struct.pack("<BI", 1, code)
    line = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<dd", *p[:2]) for p in ps)
    if kind == "Point":
        return head + struct.pack("<dd", *value[:2])
    if kind == "LineString":
        return head + line(value)
    if kind == "Polygon":
        return head + struct.pack("<I", len(value)) + b"".join(map(line, value))
    parts = value if kind == "GeometryCollection" else [(kind.removeprefix("Multi"), v) for v in value]
    return head + struct.pack("<I", len(parts)) + b"".join(map(to_wkb, parts))


def _simple(g: Geometry):
    """Points, lines and polygons of a geometry."""
    kind, value = g
    if kind == "GeometryCollection":
        for part in value:
            yield from _simple(part)
    elif kind.startswith("Multi"):
        for v in value:
            yield kind.removeprefix("Multi"), v
    else:
        yield kind, value


def cells_of(geometries: list[Geometry], res: int, touching: bool = False) -> list[np.ndarray]:
    """The distinct cells of each geometry, sorted: of points those that hold them, of lines those along them, of polygons
    those with their centres inside, or with ``touching`` all that share a point with them. All polygons go together."""
    points, point_of, ways, way_of, rings, ring_of, owner = [], [], [], [], [], [], []
    for k, g in enumerate(geometries):
        for kind, value in _simple(g):
            if not len(value):
                continue
            if kind == "Point":
                points.append((value[0], value[1]))
                point_of.append(k)
            elif kind == "LineString":
                ways.append(value)
                way_of.append(k)
            else:
                rings += value
                ring_of += [len(owner)] * len(value)
                owner.append(k)
    of, found = [], []
    if points:
        xy = np.array(points, float)
        of.append(np.array(point_of))
        found.append(G.from_lonlat(xy[:, 0], xy[:, 1], res))
    if ways:
        xy, size = _flat(ways)
        n, cells = C.lines(xy[:, 0], xy[:, 1], size, res)
        of.append(np.repeat(way_of, n))
        found.append(cells)
    if owner:
        xy, size = _flat(rings)
        end = np.cumsum(size)
        polygons = P.Polygons.of_rings(np.array(ring_of, np.int64), end - size, end, xy[:, 0], xy[:, 1], len(owner))
        n, cells = P.cells_of(polygons, res, touching)
        of.append(np.repeat(owner, n))
        found.append(cells)
    if not found:
        return [np.zeros(0, np.int64) for _ in geometries]
    of, cell = np.concatenate(of), np.concatenate(found)
    of, cell = of[cell != 0], cell[cell != 0]
    order = np.lexsort((cell, of))
    of, cell = of[order], cell[order]
    keep = np.ones(len(of), bool)
    keep[1:] = (of[1:] != of[:-1]) | (cell[1:] != cell[:-1])
    of, cell = of[keep], cell[keep]
    return np.split(cell, np.searchsorted(of, np.arange(1, len(geometries))))


def _flat(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """The first two coordinates of all points of lines or rings, and the number of points of each."""
    return np.array([v[:2] for part in parts for v in part], float).reshape(-1, 2), np.array([len(part) for part in parts], np.int64)
