"""Cells of many polygons at once: all of a batch's polygons are traced, flooded and tested together.

Pairs of a polygon's number and a cell of one resolution are kept as one 64-bit key, the number above the cell's digits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from hexloom.kernel import cells as C
from hexloom.kernel import grid as G

PAIRS = 1 << 21


@dataclass
class Polygons:
    """Segments by polygon, and each polygon's first point; rings of fewer than 3 points are left out."""

    of: np.ndarray
    start: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    some: np.ndarray
    px: np.ndarray
    py: np.ndarray

    @classmethod
    def of_rings(cls, ring_of: np.ndarray, begin: np.ndarray, end: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> Polygons:
        """From rings (sorted by polygon) as ranges of points."""
        good = end - begin >= 3
        ring_of, begin, end = ring_of[good], begin[good], end[good]
        size = end - begin
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        last = np.zeros(len(at), bool)
        last[np.cumsum(size) - 1] = True
        after = np.where(last, np.repeat(begin, size), at + 1)
        of = np.repeat(ring_of, size)
        keep = ~last | (x[at] != x[after]) | (y[at] != y[after])  # rings may be closed already
        at, after, of = at[keep], after[keep], of[keep]
        start = np.searchsorted(of, np.arange(n + 1))
        some = start[1:] > start[:-1]
        first = np.where(some, at[np.minimum(start[:-1], max(len(at) - 1, 0))] if len(at) else 0, 0)
        px, py = (v[first] if len(v) else np.zeros(n) for v in (x, y))
        return cls(of, start, x[at], y[at], x[after], y[after], some, px, py)

    def slice(self, a: int, b: int) -> Polygons:
        lo, hi = self.start[a], self.start[b]
        return Polygons(self.of[lo:hi] - a, self.start[a : b + 1] - lo, *(v[lo:hi] for v in (self.x0, self.y0, self.x1, self.y1)), *(v[a:b] for v in (self.some, self.px, self.py)))


def _spread(polygon: np.ndarray, p: Polygons):
    """Slices of the pairs (index into ``polygon``, segment of that polygon) of bounded size."""
    n = np.diff(p.start)[polygon]
    total = np.cumsum(n)
    a = 0
    while a < len(polygon):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
        size = n[a:b]
        who = np.repeat(np.arange(a, b), size)
        yield who, np.repeat(p.start[:-1][polygon[a:b]] - np.cumsum(size) + size, size) + np.arange(size.sum())
        a = b


def inside(x: np.ndarray, y: np.ndarray, polygon: np.ndarray, p: Polygons) -> np.ndarray:
    """Whether each point is inside its polygon: an odd number of crossings over all rings."""
    count = np.zeros(len(x), np.int64)
    for who, s in _spread(polygon, p):
        px, py, y0, y1 = x[who], y[who], p.y0[s], p.y1[s]
        hit = (y0 > py) != (y1 > py)
        who, s, px, py = who[hit], s[hit], px[hit], py[hit]
        left = px < (p.x1[s] - p.x0[s]) * (py - p.y0[s]) / (p.y1[s] - p.y0[s]) + p.x0[s]
        count += np.bincount(who[left], minlength=len(x))
    return count % 2 == 1


def _side(x0, y0, x1, y1, x, y) -> np.ndarray:
    return np.sign((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0))


def crossed(a: Polygons, polygon: np.ndarray, p: Polygons) -> np.ndarray:
    """Whether any segment of each of the polygons ``a`` touches one of the polygon of ``p`` that goes with it."""
    out = np.zeros(len(polygon), bool)
    size = np.diff(a.start)
    every, own = np.repeat(polygon, size), np.repeat(np.arange(len(polygon)), size)  # segments of a with their polygons
    for t, s in _spread(every, p):
        ax0, ay0, ax1, ay1 = a.x0[t], a.y0[t], a.x1[t], a.y1[t]
        bx0, by0, bx1, by1 = p.x0[s], p.y0[s], p.x1[s], p.y1[s]
        near = (np.minimum(ax0, ax1) <= np.maximum(bx0, bx1)) & (np.minimum(bx0, bx1) <= np.maximum(ax0, ax1)) & (np.minimum(ay0, ay1) <= np.maximum(by0, by1)) & (np.minimum(by0, by1) <= np.maximum(ay0, ay1))
        t = t[near]
        ax0, ay0, ax1, ay1, bx0, by0, bx1, by1 = (v[near] for v in (ax0, ay0, ax1, ay1, bx0, by0, bx1, by1))
        hit = (_side(bx0, by0, bx1, by1, ax0, ay0) * _side(bx0, by0, bx1, by1, ax1, ay1) <= 0) & (_side(ax0, ay0, ax1, ay1, bx0, by0) * _side(ax0, ay0, ax1, ay1, bx1, by1) <= 0)
        out[own[t[hit]]] = True
    return out


class _Keys:
    """Pairs of polygon and cell as sortable numbers."""

    def __init__(self, res: int):
        self.shift, self.bits = np.int64(3 * (15 - res)), np.int64(7 + 3 * res)
        self.most = 1 << min(20, 63 - int(self.bits))
        self.tail = np.int64((1 << 59) | (res << 52) | ((1 << int(self.shift)) - 1))

    def of(self, polygon: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return (polygon.astype(np.int64) << self.bits) | (cell & np.int64((1 << 52) - 1)) >> self.shift

    def split(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return key >> self.bits, ((key & ((np.int64(1) << self.bits) - 1)) << self.shift) | self.tail


#: Cells, of a rough estimate, that polygons looked at together have.
SLICE_CELLS = 1 << 16


def _weights(p: Polygons, res: int) -> np.ndarray:
    """About how many cells each polygon's envelope and rings have."""
    wide = np.degrees(C.EDGE_KM[res] / G.EARTH_KM)
    out = np.ones(len(p.some))
    if p.some.any():
        start = p.start[:-1][p.some]
        x, y = (np.maximum.reduceat(v, start) - np.minimum.reduceat(v, start) for v in (p.x0, p.y0))
        rings = np.add.reduceat(np.hypot(p.x1 - p.x0, p.y1 - p.y0), start)
        out[p.some] += x * y / (2.6 * wide**2) + 4 * rings / wide + np.diff(p.start)[p.some]
    return out


def _traced(p: Polygons, res: int, keys: _Keys) -> np.ndarray:
    """Pairs of the cells that the rings pass, and of their neighbours."""
    step = max(np.degrees(C.EDGE_KM[res] / G.EARTH_KM) * 0.5, 1e-9)
    n = np.ceil(np.maximum(np.hypot(p.x1 - p.x0, p.y1 - p.y0), 1e-12) / step).astype(np.int64) + 1
    found = []
    total = np.cumsum(n)
    a = 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, "right")))
        size = n[a:b]
        s = np.repeat(np.arange(a, b), size)
        t = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)) / (size - 1)[s - a]
        h = G.from_lonlat(p.x0[s] + (p.x1[s] - p.x0[s]) * t, p.y0[s] + (p.y1[s] - p.y0[s]) * t, res)
        found.append(np.unique(keys.of(p.of[s], h)[h != 0]))
        a = b
    return _with_neighbors(np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64), keys)


def _neighbors(key: np.ndarray, keys: _Keys) -> np.ndarray:
    polygon, cell = keys.split(key)
    uniq, which = np.unique(cell, return_inverse=True)
    near = G.neighbors(uniq)[which] if len(uniq) else np.zeros((0, 6), np.int64)
    owner = np.repeat(polygon, near.shape[1])
    near = near.ravel()
    return np.unique(keys.of(owner[near != 0], near[near != 0]))


def _with_neighbors(key: np.ndarray, keys: _Keys) -> np.ndarray:
    return np.union1d(key, _neighbors(key, keys))


def _flooded(p: Polygons, keys: _Keys, front: np.ndarray) -> np.ndarray:
    """Pairs of the cells with their centres inside, from those along the rings."""
    seen, found = front, [np.zeros(0, np.int64)]
    while len(front):
        polygon, cell = keys.split(front)
        uniq, which = np.unique(cell, return_inverse=True)
        lon, lat = G.to_lonlat(uniq)
        good = front[inside(lon[which], lat[which], polygon, p)]
        found.append(good)
        front = np.setdiff1d(_neighbors(good, keys), seen, assume_unique=True)
        seen = np.union1d(seen, front)
    return np.unique(np.concatenate(found))


def _touching(p: Polygons, keys: _Keys, edge: np.ndarray) -> np.ndarray:
    """Of the pairs along the rings, those whose cell shares a point with the polygon."""
    polygon, cell = keys.split(edge)
    uniq, which = np.unique(cell, return_inverse=True)
    n, rings = G.boundaries(uniq)
    size = n[which]
    xy = rings[which][np.arange(12) < size[:, None]]
    end = np.cumsum(size)
    own = Polygons.of_rings(np.arange(len(size)), end - size, end, xy[:, 0], xy[:, 1], len(size))
    hit = crossed(own, polygon, p) | inside(own.px, own.py, polygon, p)
    hit |= inside(p.px[polygon], p.py[polygon], np.arange(len(size)), own)
    return edge[hit]


def cells_of(p: Polygons, res: int, touching: bool = False, around: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Cells whose centres are inside (or with ``touching`` that share a point with) each polygon, sorted: the number of
    cells of each polygon, and all of them. ``around``: and their neighbours."""
    keys, n = _Keys(res), len(p.some)
    counts, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    total = np.cumsum(_weights(p, res))
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SLICE_CELLS, "right")))
        b = min(b, a + keys.most)
        part, a = p.slice(a, b), b
        edge = _traced(part, res, keys)
        found = _flooded(part, keys, edge)
        if touching:
            found = np.union1d(found, _touching(part, keys, edge))
        if around:
            found = _with_neighbors(found, keys)
        polygon, cell = keys.split(found)
        counts.append(np.bincount(polygon, minlength=len(part.some)))
        out.append(cell)
    return np.concatenate(counts), np.concatenate(out)
