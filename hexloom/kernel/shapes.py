"""Planar geometry in degrees: polygons to cells, cells to polygons, smoothing, simplification, predicates.

A polygon is a list of rings, the outer one first; a ring is an array of (lon, lat).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

from hexloom.kernel import cells as C
from hexloom.kernel import grid as G
from hexloom.kernel import polygons as P

Ring = np.ndarray


def closed(ring) -> Ring:
    ring = np.asarray(ring, float)
    return ring if len(ring) and (ring[0] == ring[-1]).all() else np.vstack([ring, ring[:1]])


def signed_area(ring: Ring) -> float:
    r = closed(ring)
    return float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() / 2)


def inside(points: np.ndarray, rings: list) -> np.ndarray:
    """Whether points are inside a polygon (crossing count over all rings; holes are outside)."""
    out = np.zeros(len(points), bool)
    x, y = points[:, 0], points[:, 1]
    for ring in rings:
        r = closed(ring)
        for (x0, y0), (x1, y1) in zip(r[:-1], r[1:], strict=True):
            if y0 != y1:
                hit = (y0 > y) != (y1 > y)
                out ^= hit & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return out


def _segments(rings: list) -> np.ndarray:
    return np.concatenate([np.hstack([closed(r)[:-1], closed(r)[1:]]) for r in rings])


def segments_cross(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether any segment (x0, y0, x1, y1) of ``a`` touches any of ``b``."""
    p, q = a[:, None, :], b[None, :, :]

    def side(x0, y0, x1, y1, x, y):
        return np.sign((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0))

    d1, d2 = side(*(q[..., k] for k in range(4)), p[..., 0], p[..., 1]), side(*(q[..., k] for k in range(4)), p[..., 2], p[..., 3])
    d3, d4 = side(*(p[..., k] for k in range(4)), q[..., 0], q[..., 1]), side(*(p[..., k] for k in range(4)), q[..., 2], q[..., 3])
    boxes = (np.minimum(p[..., 0], p[..., 2]) <= np.maximum(q[..., 0], q[..., 2])) & (np.minimum(q[..., 0], q[..., 2]) <= np.maximum(p[..., 0], p[..., 2]))
    boxes &= (np.minimum(p[..., 1], p[..., 3]) <= np.maximum(q[..., 1], q[..., 3])) & (np.minimum(q[..., 1], q[..., 3]) <= np.maximum(p[..., 1], p[..., 3]))
    return bool((boxes & (d1 * d2 <= 0) & (d3 * d4 <= 0)).any())


def intersects(a: list, b: list) -> bool:
    """Whether two polygons share a point, their boundaries included."""
    return segments_cross(_segments(a), _segments(b)) or bool(inside(np.asarray(a[0])[:1], b)[0]) or bool(inside(np.asarray(b[0])[:1], a)[0])


def box(x0, y0, x1, y1) -> list:
    return [np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)]


# ---- polygons to cells -------------------------------------------------------------------------------------------


def _trace(rings: list, res: int) -> np.ndarray:
    """Cells that the rings pass, from points closer to each other than a cell is wide."""
    step = max(np.degrees(C.EDGE_KM[res] / G.EARTH_KM) * 0.5, 1e-9)
    points = []
    for ring in rings:
        r = closed(ring)
        for p, q in zip(r[:-1], r[1:], strict=True):
            n = int(np.ceil(max(np.hypot(*(q - p)), 1e-12) / step)) + 1
            points.append(p + (q - p) * np.linspace(0, 1, n)[:, None])
    p = np.concatenate(points)
    return np.unique(G.from_lonlat(p[:, 0], p[:, 1], res))


def _widened(cells: np.ndarray) -> np.ndarray:
    near = np.unique(np.concatenate([cells, G.neighbors(cells).ravel()]))
    return near[near != 0]


def polygon_cells(rings: list, res: int) -> np.ndarray:
    """Cells whose centres are inside a polygon: flooded from the cells along its rings."""
    rings = [np.asarray(r, float) for r in rings if len(r) >= 3]
    if not rings:
        return np.zeros(0, np.int64)
    front = seen = _widened(_trace(rings, res))
    found = []
    while len(front):
        lon, lat = G.to_lonlat(front)
        good = front[inside(np.stack([lon, lat], axis=1), rings)]
        found.append(good)
        near = np.unique(G.neighbors(good).ravel()) if len(good) else np.zeros(0, np.int64)
        front = np.setdiff1d(near[near != 0], seen, assume_unique=True)
        seen = np.union1d(seen, front)
    return np.unique(np.concatenate(found))


def polygon_cells_touching(rings: list, res: int) -> np.ndarray:
    """Cells that share a point with a polygon."""
    rings = [np.asarray(r, float) for r in rings if len(r) >= 3]
    if not rings:
        return np.zeros(0, np.int64)
    edge = _widened(_trace(rings, res))
    good = [h for h, b in zip(edge.tolist(), G.boundary(edge), strict=True) if intersects([b], rings)]
    return np.union1d(polygon_cells(rings, res), np.array(good, np.int64))


# ---- cells to polygons -------------------------------------------------------------------------------------------


def _vertex_ids(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Equal numbers for points that differ only in their last bits: grid cells, then grid cells shifted by a half."""
    ids = np.unique(np.floor(points / tolerance).astype(np.int64), axis=0, return_inverse=True)[1].ravel()
    for shift in ((0.5, 0.0), (0.0, 0.5), (0.5, 0.5)):
        other = np.unique(np.floor(points / tolerance + shift).astype(np.int64), axis=0, return_inverse=True)[1].ravel()
        low = np.full(other.max() + 1, len(points))
        np.minimum.at(low, other, ids)
        best = np.full(ids.max() + 1, len(points))
        np.minimum.at(best, ids, low[other])
        ids = best[ids]
    return ids


@dataclass
class Dissolved:
    """Polygons of many groups of cells: the points of all closed rings, where each ring and each polygon begins (with the
    end of the last), and the number of polygons of each group."""

    points: np.ndarray
    rings: np.ndarray
    polygons: np.ndarray
    size: np.ndarray

    def lists(self) -> list[list[list[Ring]]]:
        rings = np.split(self.points, self.rings[1:-1]) if len(self.rings) > 1 else []
        polygons = [rings[a:b] for a, b in zip(self.polygons[:-1].tolist(), self.polygons[1:].tolist(), strict=True)]
        last = np.cumsum(self.size)
        return [polygons[a:b] for a, b in zip((last - self.size).tolist(), last.tolist(), strict=True)]


def dissolve(cells) -> list[list[Ring]]:
    """Polygons of the union of cells of one resolution."""
    cells = np.asarray(cells, np.int64)
    return dissolve_all(cells, np.zeros(len(cells), np.int64), 1).lists()[0]


def dissolve_all(cells: np.ndarray, group: np.ndarray, n: int) -> Dissolved:
    """Polygons of the unions of ``n`` groups of cells, a group being of one resolution: edges shared by two cells of a
    group cancel, the rest is chained."""
    uniq, which = np.unique(cells, return_inverse=True)
    pair = np.unique(group.astype(np.int64) * len(uniq) + which)
    group, which = pair // max(len(uniq), 1), pair % max(len(uniq), 1)
    # the edges of all distinct cells, and which of them is the other's reverse
    size, rings = G.boundaries(uniq)
    points, begin = rings[np.arange(12) < size[:, None]], np.cumsum(size) - size
    of = np.repeat(np.arange(len(uniq)), size)
    after = np.arange(len(points)) + 1
    after[begin + size - 1] = begin
    ids, known = np.zeros(len(points), np.int64), 0
    for res, at in G.by_resolution(uniq[of]):
        ids[at] = known + _vertex_ids(points[at], np.degrees(C.EDGE_KM[res] / G.EARTH_KM) * 1e-3)
        known = int(ids[at].max()) + 1
    a, b = ids, ids[after]
    code, name = np.unique(a * known + b, return_inverse=True)
    back = np.minimum(np.searchsorted(code, b * known + a), max(len(code) - 1, 0))
    back = np.where(code[back] == b * known + a, back, -1)
    # those of each group
    edge = C._ranges(begin[which], size[which])
    own = np.repeat(group, size[which])
    single = ~np.isin(own * len(code) + back[edge], (own * len(code) + name[edge])) | (back[edge] < 0)
    edge, own = edge[single], own[single]
    at, loop = _loops(own * known + a[edge], own * known + b[edge])
    edge, own = edge[at], own[at]
    # loops of three points or more, closed
    length = np.bincount(loop)
    keep = (length >= 3)[loop]
    edge, own, length = edge[keep], own[keep], length[length >= 3]
    start = np.cumsum(length) - length
    own = own[start]  # of loops
    x, y = points[edge].T
    then = np.arange(len(edge)) + 1
    then[start + length - 1] = start
    area = np.add.reduceat(x * y[then] - x[then] * y, start) / 2 if len(start) else np.zeros(0)
    outer = area > 0
    within = _surrounding(x, y, start, length, own, area, outer)
    # outer rings in order, each followed by its holes
    take = np.flatnonzero(outer | (within >= 0))
    first = np.where(outer, np.arange(len(start)), within)[take]
    take = take[np.lexsort((take, ~outer[take], first))]
    size = length[take]
    spot = np.repeat(start[take], size + 1) + C._ranges(np.zeros(len(take), np.int64), size + 1) % np.repeat(size, size + 1)
    return Dissolved(
        points[edge[spot]],
        np.concatenate([[0], np.cumsum(size + 1)]),
        np.concatenate([np.flatnonzero(outer[take]), [len(take)]]),
        np.bincount(own[outer], minlength=n),
    )


def _loops(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from ``a`` to ``b`` chained: their positions loop by loop, and each one's loop. A loop begins with its first
    edge, loops are in order of these. Of edges that begin alike the last counts."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every, rank = np.unique(a, return_inverse=True)
    spot = np.minimum(np.searchsorted(every, b), len(every) - 1)
    if len(every) < len(a) or (every[spot] != b).any() or len(np.unique(spot)) < len(a):
        return _chained(a, b)
    edge_at = np.empty(len(a), np.int64)
    edge_at[rank] = np.arange(len(a))
    after = edge_at[spot]
    low, jump = np.arange(len(a)), after
    while True:  # the first edge of each loop, over steps of double lengths
        less = np.minimum(low, low[jump])
        if (less == low).all():
            break
        low, jump = less, jump[jump]
    end = after == low
    jump, left = np.where(end, np.arange(len(a)), after), np.where(end, 0, 1)
    while True:  # the number of edges to the loop's last one
        more = left[jump]
        if not more.any():
            break
        left, jump = left + more, jump[jump]
    order = np.lexsort((-left, low))
    return order, np.unique(low, return_inverse=True)[1][order]


def _chained(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``_loops``, edge by edge, where edges that begin or end alike, or lead nowhere, make it no set of cycles."""
    nxt = dict(zip(a.tolist(), zip(b.tolist(), range(len(a)), strict=True), strict=True))
    out, loop, n = [], [], 0
    while nxt:
        at = next(iter(nxt))
        while at in nxt:
            at, p = nxt.pop(at)
            out.append(p)
            loop.append(n)
        n += 1
    return np.array(out), np.array(loop)


def _surrounding(x, y, start, length, own, area, outer) -> np.ndarray:
    """For each loop that is a hole the smallest outer loop of its group that holds its first side's beginning, or -1."""
    out = np.full(len(start), -1)
    holes, rings = np.flatnonzero(~outer), np.flatnonzero(outer)
    if not len(holes) or not len(rings):
        return out
    end = (start + length)[rings]
    shapes = P.Polygons.of_rings(np.arange(len(rings)), start[rings], end, x, y, len(rings))
    px, py = (v[start[holes]] * (1 - 1e-9) + v[start[holes] + 1] * 1e-9 for v in (x, y))
    lo, hi = np.searchsorted(own[rings], own[holes]), np.searchsorted(own[rings], own[holes], "right")
    total = np.cumsum(hi - lo)
    a = 0
    while a < len(holes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + P.PAIRS, "right")))
        who, ring = np.repeat(np.arange(a, b), (hi - lo)[a:b]), C._ranges(lo[a:b], (hi - lo)[a:b])
        hit = P.inside(px[who], py[who], ring, shapes)
        who, ring = who[hit], rings[ring[hit]]
        order = np.lexsort((ring, area[ring], who))
        who, ring = who[order], ring[order]
        first = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
        out[holes[who[first]]] = ring[first]
        a = b
    return out


def thinned(points: Ring, area: float, cyclic: bool) -> Ring:
    """A line, or with ``cyclic`` a ring without its closing point, without the points that matter least.

    A point matters by the triangle with its two neighbours. The one with the least goes, its neighbours are measured
    anew (never as less than what has gone), until all that are left matter more than ``area``. A line keeps its ends, a
    ring three points.
    """
    n = len(points)
    ahead, behind = np.roll(np.arange(n), -1), np.roll(np.arange(n), 1)
    matters = np.full(n, np.inf)

    def measure(j: int, least: float = 0.0) -> None:
        if cyclic or 0 < j < n - 1:
            p, q, r = points[[behind[j], j, ahead[j]]]
            matters[j] = max(least, abs((q[0] - p[0]) * (r[1] - p[1]) - (r[0] - p[0]) * (q[1] - p[1])) / 2)
            heapq.heappush(queue, (matters[j], j))

    queue: list[tuple[float, int]] = []
    for j in range(n):
        measure(j)
    gone = np.zeros(n, bool)
    while queue and n - gone.sum() > (3 if cyclic else 2):
        size, j = heapq.heappop(queue)
        if size > area:
            break
        if gone[j] or size != matters[j]:
            continue  # measured anew since
        gone[j] = True
        ahead[behind[j]], behind[ahead[j]] = ahead[j], behind[j]
        for k in (int(behind[j]), int(ahead[j])):
            measure(k, size)
    return points[~gone]


def simplify_dp(points: Ring, tolerance: float) -> Ring:
    """Douglas-Peucker."""
    n = len(points)
    keep = np.zeros(n, bool)
    keep[[0, n - 1]] = True
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, q, mid = points[a], points[b], points[a + 1 : b]
        d = q - p
        length = np.hypot(*d)
        off = np.abs(d[0] * (mid[:, 1] - p[1]) - d[1] * (mid[:, 0] - p[0])) / length if length else np.hypot(*(mid - p).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def smooth(points: Ring) -> Ring:
    """A line or ring through the middles of its segments, without those that nearly lie on a line.

    What goes matters no more than three quarters of the first corner does. A ring is thinned all around, wherever it
    begins; a line keeps its ends.
    """
    points = np.asarray(points, float)
    if len(points) < 3:
        return points
    area = 0.75 * abs(signed_area(points[:3]))
    middles = (points[1:] + points[:-1]) / 2
    if (points[0] == points[-1]).all():
        return closed(thinned(middles, area, cyclic=True))
    return thinned(np.concatenate([points[:1], middles, points[-1:]]), area, cyclic=False)


def smooth_polygon(rings: list[Ring]) -> list[Ring]:
    return [closed(smooth(r)) for r in rings]


def aligned(cells, res: int, smoothen: bool = True) -> list[list[Ring]]:
    """Polygons by ancestor at ``res``; when smoothed, corners near a corner of the ancestor are moved onto it."""
    cells = np.asarray(cells, np.int64)
    up = (cells & ~np.int64(15 << 52)) | np.int64(res << 52) | np.int64((1 << ((15 - res) * 3)) - 1)
    out = []
    for parent in np.unique(up):
        group = cells[up == parent]
        polygons = dissolve(group)
        if smoothen:
            corners = closed(G.boundary([parent])[0])
            first = G.boundary(group[:1])[0]
            reach = np.hypot(*(first[0] - first[1]))
            for p in map(smooth_polygon, polygons):
                d = np.hypot(p[0][:, None, 0] - corners[None, :, 0], p[0][:, None, 1] - corners[None, :, 1]) < reach
                p[0] = np.where(d.any(axis=1)[:, None], corners[d.argmax(axis=1)], p[0])
                out.append(p)
        else:
            out += polygons
    return out


def covered_area(cells, res: int) -> list[list[Ring]]:
    """Outlines, without holes, of the area of cells coarsened to ``res``."""
    cells = np.asarray(cells, np.int64)
    up = (cells & ~np.int64(15 << 52)) | np.int64(res << 52) | np.int64((1 << ((15 - res) * 3)) - 1)
    return [[simplify_dp(closed(smooth(p[0])), 1e-6)] for p in dissolve(np.unique(up))]


def concave_hull(points: np.ndarray, concavity: float = 2.0) -> Ring:
    """A hull that starts convex and digs to the nearest inner point of edges that are long for their surroundings."""
    points = np.unique(np.asarray(points, float), axis=0)
    if len(points) < 4:
        return closed(points)
    order = points[np.lexsort((points[:, 1], points[:, 0]))]

    def half(ps):
        out: list = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(tuple(p))
        return out[:-1]

    hull = half(order) + half(order[::-1])
    rest = {tuple(p) for p in points} - set(hull)
    todo, edges = list(zip(hull, hull[1:] + hull[:1], strict=True)), []
    while todo:
        p, q = todo.pop(0)
        length = np.hypot(p[0] - q[0], p[1] - q[1])
        best = None
        if rest and length:
            inner = np.array(list(rest))
            d0, d1 = np.hypot(*(inner - p).T), np.hypot(*(inner - q).T)
            near = np.minimum(d0, d1)
            k = int(near.argmin())
            if length / max(near[k], 1e-15) > concavity and max(d0[k], d1[k]) < length:
                best = tuple(inner[k])
        if best is None:
            edges.append((p, q))
        else:
            rest.discard(best)
            todo[:0] = [(p, best), (best, q)]
    return closed(np.array([p for p, _ in edges]))


# ---- areas on the sphere -----------------------------------------------------------------------------------------

EARTH_RADIUS_EQUATOR_M = 6378137.0


def ring_area_m2(ring: Ring) -> float:
    """Approximate area of a ring on a sphere of the equator's radius (Chamberlain and Duquette)."""
    r = np.radians(closed(ring))
    return float(abs(((r[1:, 0] - r[:-1, 0]) * (2 + np.sin(r[:-1, 1]) + np.sin(r[1:, 1]))).sum()) * EARTH_RADIUS_EQUATOR_M**2 / 2)
