"""Measures, directed edges, local coordinates and paths of cells, on arrays."""

from __future__ import annotations

import numpy as np

from hexloom.kernel import grid as G

# fixed values of the published grid, by resolution: average hexagon area in km2, average edge length in km
AREA_KM2 = np.array([
    4.357449416078383e6, 6.097884417941332e5, 8.680178039899720e4, 1.239343465508816e4, 1.770347654491307e3,
    2.529038581819449e2, 3.612906216441245e1, 5.161293359717191, 7.373275975944177e-1, 1.053325134272067e-1,
    1.504750190766435e-2, 2.149643129451879e-3, 3.070918756316060e-4, 4.387026794728296e-5, 6.267181135324313e-6,
    8.953115907605790e-7,
])
EDGE_KM = np.array([
    1281.256011, 483.0568391, 182.5129565, 68.97922179, 26.07175968, 9.854090990, 3.724532667, 1.406475763,
    0.531414010, 0.200786148, 0.075863783, 0.028663897, 0.010830188, 0.004092010, 0.001546100, 0.000584169,
])
_EDGE = np.int64((1 << 59) * 2)
_HEAD = np.int64(~(127 << 56))


def areas_rads2(h) -> np.ndarray:
    """Exact spherical areas: the sum of the triangles between centre and boundary."""
    lon, lat = G.to_lonlat(h)
    centre = G.xyz(np.radians(lat), np.radians(lon))
    out = np.zeros(len(centre))
    for k, ring in enumerate(G.boundary(h)):
        v = G.xyz(np.radians(ring[:, 1]), np.radians(ring[:, 0]))
        w = np.roll(v, -1, axis=0)
        c = centre[k]
        out[k] = 2 * np.arctan2(np.cross(v, w) @ c, 1 + v @ c + (v * w).sum(axis=1) + w @ c).sum()
    return out


def great_circle_rads(lon1, lat1, lon2, lat2) -> np.ndarray:
    lon1, lat1, lon2, lat2 = map(np.radians, (lon1, lat1, lon2, lat2))
    a = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


# ---- directed edges ----------------------------------------------------------------------------------------------


def edge_to(origin, destination) -> np.ndarray:
    """Directed edges between neighbours, 0 where the two aren't."""
    origin, destination = np.asarray(origin, np.int64), np.asarray(destination, np.int64)
    cells, which = np.unique(origin, return_inverse=True)
    near = G.neighbors(cells)[which] == destination[:, None]
    way = near.argmax(axis=1) + 1
    good = near.any(axis=1) & (destination != 0)
    return np.where(good, (origin & _HEAD) | _EDGE | (way.astype(np.int64) << 56), 0)


def edge_origin(e) -> np.ndarray:
    return (np.asarray(e, np.int64) & _HEAD) | np.int64(1 << 59)


def edge_destination(e) -> np.ndarray:
    e = np.asarray(e, np.int64)
    cells, which = np.unique(edge_origin(e), return_inverse=True)
    return G.neighbors(cells)[which, ((e >> 56) & 7) - 1]


def edge_reversed(e) -> np.ndarray:
    return edge_to(edge_destination(e), edge_origin(e))


def is_valid_edge(e) -> np.ndarray:
    e = np.asarray(e, np.int64)
    way, origin = (e >> 56) & 7, edge_origin(e)
    return (e > 0) & ((e >> 59) == 2) & (way >= 1) & (way <= 6) & G.is_valid(origin) & ~(G.is_pentagon(origin) & (way == 1))


#: Edges whose cells are compared at a time.
SLICE = 4096


def edge_boundaries(e) -> tuple[np.ndarray, np.ndarray]:
    """The vertices that both cells of an edge share, in the origin's order, as (lon, lat) in degrees: the number of each
    edge, and all of them."""
    e = np.asarray(e, np.int64)
    uniq, which = np.unique(np.concatenate([edge_origin(e), edge_destination(e)]), return_inverse=True)
    size, rings = G.boundaries(uniq)
    rings = rings[:, : int(size.max(initial=0))]
    count, out = [np.zeros(0, np.int64)], [np.zeros((0, 2))]
    for lo in range(0, len(e), SLICE):
        at, far = which[: len(e)][lo : lo + SLICE], which[len(e) :][lo : lo + SLICE]
        a, n, spot = rings[at], size[at][:, None], np.arange(rings.shape[1])
        d = np.abs(a[:, :, None] - rings[far][:, None])
        d[..., 0] = np.minimum(d[..., 0], 360 - d[..., 0])
        height = np.abs(np.take_along_axis(a[..., 1], (spot + 1) % n, axis=1) - a[..., 1])
        height = np.where(spot < n, height, 0.0).max(axis=1)
        shared = (d.max(axis=3) < 1e-6 * np.maximum(1e-3, height)[:, None, None]).any(axis=2)
        start = (shared & ~np.take_along_axis(shared, (spot - 1) % n, axis=1)).argmax(axis=1)
        order = (start[:, None] + spot) % n
        take = np.take_along_axis(shared, order, axis=1) & (spot < n)
        count.append(take.sum(axis=1))
        out.append(np.take_along_axis(a, order[..., None], axis=1)[take])
    return np.concatenate(count), np.concatenate(out)


def edge_boundary(e) -> list[np.ndarray]:
    """The vertices of ``edge_boundaries`` of each edge."""
    n, xy = edge_boundaries(e)
    return np.split(xy, np.cumsum(n)[:-1]) if len(n) else []


def edge_lengths_rads(e) -> np.ndarray:
    n, xy = edge_boundaries(e)
    of = np.repeat(np.arange(len(n)), n)
    go = np.flatnonzero(of[1:] == of[:-1]) if len(of) else np.zeros(0, np.int64)
    p, q = xy[go], xy[go + 1]
    return np.bincount(of[go], great_circle_rads(p[:, 0], p[:, 1], q[:, 0], q[:, 1]), len(n))


# ---- local coordinates -------------------------------------------------------------------------------------------


def _base_neighbors():
    """Per base cell and direction: the base cell there, and turns into its axes; pentagons have none."""
    to, turns = np.full((122, 7), -1), np.zeros((122, 7), np.int64)
    base = np.flatnonzero(~G.PENTAGON)
    to[:, 0] = np.arange(122)
    for n in range(1, 7):
        a, b = G.HOME_AT[base, 0] + G.STEP[n, 0], G.HOME_AT[base, 1] + G.STEP[n, 1]
        face, a, b, t = G.settle(G.HOME_FACE[base], a, b, 1)
        m = np.minimum(np.minimum(a, b), 0)
        to[base, n] = G.FACE_BASE[face, a - m, b - m, -m]
        turns[base, n] = (t + G.FACE_TURNS[face, a - m, b - m, -m]) % 6
    return to, turns


BASE_TO, BASE_TURNS = _base_neighbors()


def _walk(d, a, b, res: int):
    for r in range(1, res + 1):
        a, b = G.down7(a, b, r % 2 == 1)
        a, b = a + G.STEP[d[r - 1], 0], b + G.STEP[d[r - 1], 1]
    return a, b


def local_ij(origin, h, res: int):
    """(i, j) of cells in the axes of their origins' base cells, and where they can't be computed.

    That is so across more than one base cell, and wherever a pentagon's base cell takes part.
    """
    ob, hb = G.base_cell(origin), G.base_cell(h)
    way = (BASE_TO[ob] == hb[:, None]).argmax(axis=1)
    good = (BASE_TO[ob] == hb[:, None]).any(axis=1) & ~G.PENTAGON[ob] & ~G.PENTAGON[hb]
    turns = np.where(good, BASE_TURNS[ob, way], 0)
    d = G.digits(h, res)
    for t in range(6):
        d = np.where(turns > t, G.CW[d], d)
    a, b = _walk(d, G.STEP[np.where(good, way, 0), 0], G.STEP[np.where(good, way, 0), 1], res)
    return a, b, good


def from_local_ij(origin, i, j, res: int) -> np.ndarray:
    """Cells at local coordinates of their origins, 0 where that can't be computed."""
    a, b = np.asarray(i, np.int64), np.asarray(j, np.int64)
    base = G.base_cell(origin)
    d = np.zeros((res, len(a)), np.int64)
    for r in range(res, 0, -1):
        pa, pb = G.up7(a, b, r % 2 == 1)
        ca, cb = G.down7(pa, pb, r % 2 == 1)
        d[r - 1] = G._DIGIT[a - ca + 1, b - cb + 1]
        a, b = pa, pb
    good = (np.abs(a) <= 1) & (np.abs(b) <= 1) & ~G.PENTAGON[base]
    way = np.where(good, G._DIGIT[np.clip(a, -1, 1) + 1, np.clip(b, -1, 1) + 1], 0)
    good &= way < 7
    way = np.where(good, way, 0)
    to = BASE_TO[base, way]
    good &= (to >= 0) & ~G.PENTAGON[np.maximum(to, 0)]
    turns = np.where(good, BASE_TURNS[base, way], 0)
    for t in range(6):
        d = np.where(turns > t, G.CCW[d], d)
    return np.where(good, G.pack(np.maximum(to, 0), d, res), 0)


#: How far cells are searched step by step where coordinates fail: around pentagons, and across base cells.
STEPS = 10


def distances(a, b) -> np.ndarray:
    """Grid distances of cells; -1 across resolutions, and beyond ``STEPS`` where coordinates fail: across more than one
    base cell, and where a pentagon's base cell takes part."""
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    out = np.where(a == b, 0, -1)
    same = G.resolution(a) == G.resolution(b)
    for res, at in G.by_resolution(a):
        at = at[same[at]]
        if not len(at):
            continue
        i0, j0, good0 = local_ij(a[at], a[at], res)
        i1, j1, good1 = local_ij(a[at], b[at], res)
        i, j = i1 - i0, j1 - j0
        d = np.maximum(np.maximum(abs(i), abs(j)), abs(i - j))
        out[at] = np.where(good0 & good1, d, out[at])
    left = np.flatnonzero((out < 0) & same)
    left = left[_maybe_near(a[left], b[left])]
    for lo in range(0, len(left), 2048):
        part = left[lo : lo + 2048]
        o, cell, k = G.disk_distances(a[part], STEPS)
        hit = cell == b[part][o]
        out[part[o[hit]]] = k[hit]
    return out


def _maybe_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether centres are no further apart than ``STEPS`` of the widest steps."""
    if not len(a):
        return np.zeros(0, bool)
    far = great_circle_rads(*G.to_lonlat(a), *G.to_lonlat(b)) * G.EARTH_KM
    return far <= STEPS * EDGE_KM[G.resolution(a)] * np.sqrt(3) * 1.5


#: Cells that one slice of the pairs of ``paths`` may have.
PATH_CELLS = 1 << 20


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of ranges, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def paths(a, b) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the straight line between the two cells of each pair, both included, or where coordinates fail of a
    shortest way of up to ``STEPS`` steps: the number of cells of each pair, and all of them. It is 0 beyond that, and
    across resolutions."""
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    size = np.where(a == b, 1, 0)
    found = [(np.flatnonzero(a == b), a[a == b])]
    left = (a != b) & (G.resolution(a) == G.resolution(b))
    for res, at in G.by_resolution(a):
        at = at[left[at]]
        (i0, j0, good0), (i1, j1, good1) = local_ij(a[at], a[at], res), local_ij(a[at], b[at], res)
        good = good0 & good1
        at, i0, j0, i1, j1 = (v[good] for v in (at, i0, j0, i1, j1))
        steps = np.maximum(np.maximum(abs(i1 - i0), abs(j1 - j0)), abs((i1 - i0) - (j1 - j0)))
        total = np.cumsum(steps + 1)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PATH_CELLS, "right")))
            part = slice(lo, hi)
            own, cells = _straight(a[at[part]], *(v[part] for v in (i0, j0, i1, j1, steps)), res)
            whole = np.bincount(own[cells == 0], minlength=hi - lo) == 0
            size[at[part][whole]] = steps[part][whole] + 1
            left[at[part][whole]] = False
            found.append((at[part][own[whole[own]]], cells[whole[own]]))
            lo = hi
    near = np.flatnonzero(left)
    near = near[_maybe_near(a[near], b[near])]
    for lo in range(0, len(near), 1024):
        part = near[lo : lo + 1024]
        n, cells = _stepwise(a[part], b[part])
        size[part] = n
        found.append((np.repeat(part, n), cells))
    pair, cells = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return size, cells[np.argsort(pair, kind="stable")]


def _straight(origin, i0, j0, i1, j1, steps, res: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of the pair and the cell, 0 where there is none, of each step of straight lines."""
    own = np.repeat(np.arange(len(origin)), steps + 1)
    t = (np.arange(len(own)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)) / steps[own]
    # cube coordinates with axes 60 degrees apart, whose third is the negative sum
    q0, q1, r0, r1 = i0 - j0, i1 - j1, j0, j1
    q, r = q0[own] + (q1 - q0)[own] * t, r0[own] + (r1 - r0)[own] * t
    s = -q - r
    rq, rr, rs = np.rint(q), np.rint(r), np.rint(s)
    dq, dr, ds = abs(rq - q), abs(rr - r), abs(rs - s)
    rq2 = np.where((dq > dr) & (dq > ds), -rr - rs, rq)
    rr2 = np.where((dr >= ds) & ~((dq > dr) & (dq > ds)), -rq - rs, rr)
    return own, from_local_ij(origin[own], (rq2 + rr2).astype(np.int64), rr2.astype(np.int64), res)


def path(a: int, b: int) -> np.ndarray | None:
    """The cells of ``paths`` for one pair; None where there are none."""
    n, cells = paths([a], [b])
    return cells if n[0] else None


def _stepwise(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shortest way for each pair, of those the one of the smallest cells from the end on: the number of cells, 0 beyond
    ``STEPS``, and all cells."""
    o, cell, k = G.disk_distances(a, STEPS)
    every, rank = np.unique(cell, return_inverse=True)
    key = o * len(every) + rank
    order = np.argsort(key)
    key, k = key[order], k[order]

    def steps(own: np.ndarray, c: np.ndarray) -> np.ndarray:
        spot = np.minimum(np.searchsorted(every, c), len(every) - 1)
        at = np.minimum(np.searchsorted(key, own * len(every) + spot), len(key) - 1)
        return np.where((every[spot] == c) & (key[at] == own * len(every) + spot), k[at], -1)

    own = np.arange(len(a))
    far = steps(own, b)
    way = np.zeros((len(a), STEPS + 1), np.int64)
    here, own = b[far >= 0], own[far >= 0]
    left = far[own]
    way[own, left] = here
    while (left > 0).any():
        here, own, left = here[left > 0], own[left > 0], left[left > 0] - 1
        near = G.neighbors(here)
        fits = steps(np.repeat(own, 6), near.ravel()).reshape(-1, 6) == left[:, None]
        here = np.where(fits, near, np.iinfo(np.int64).max).min(axis=1)
        way[own, left] = here
    return far + 1, way[np.arange(STEPS + 1) <= far[:, None]]


def _bent(a: np.ndarray, b: np.ndarray, depth: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """As ``paths``, where that fails over the middles of ever shorter stretches of the great circle; all pairs together."""
    n, cells = paths(a, b)
    left = np.flatnonzero(n == 0)
    if not len(left) or not depth:
        return n, cells
    middle = np.zeros(len(left), np.int64)
    lon, lat = np.radians(G.to_lonlat(a[left])), np.radians(G.to_lonlat(b[left]))
    x, y, z = (G.xyz(lon[1], lon[0]) + G.xyz(lat[1], lat[0])).T
    for res, at in G.by_resolution(a[left]):
        middle[at] = G.from_lonlat(np.degrees(np.arctan2(y[at], x[at])), np.degrees(np.arctan2(z[at], np.hypot(x[at], y[at]))), res)
    good = (middle != a[left]) & (middle != b[left]) & (middle != 0)
    left, middle = left[good], middle[good]
    if not len(left):
        return n, cells
    m, more = _bent(np.concatenate([a[left], middle]), np.concatenate([middle, b[left]]), depth - 1)
    start = np.cumsum(m) - m + len(cells)
    both = (m[: len(left)] > 0) & (m[len(left) :] > 0)
    at, size = np.zeros((len(n), 2), np.int64), np.zeros((len(n), 2), np.int64)
    at[:, 0], size[:, 0] = np.cumsum(n) - n, n
    for side in (0, 1):
        half = slice(side * len(left), (side + 1) * len(left))
        at[left[both], side], size[left[both], side] = start[half][both] + side, m[half][both] - side
    return size.sum(axis=1), np.concatenate([cells, more])[_ranges(at.ravel(), size.ravel())]


def lines(x: np.ndarray, y: np.ndarray, size: np.ndarray, res: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells along polylines, whose points follow each other, in order, without adjacent repeats and without gaps: the
    number of cells of each line, and all of them. It is 0 for points that are no coordinates."""
    cells = G.from_lonlat(x, y, res)
    of = np.repeat(np.arange(len(size)), size)
    good = (np.bincount(of[cells == 0], minlength=len(size)) == 0) & (size > 0)
    go = np.flatnonzero((of[1:] == of[:-1]) & good[of[1:]]) if len(of) else np.zeros(0, np.int64)
    n, between = _bent(cells[go], cells[go + 1])
    good[of[go[n == 0]]] = False
    at, length = np.arange(len(of)), np.ones(len(of), np.int64)
    at[go + 1], length[go + 1] = np.cumsum(n) - n + len(of), n
    length[~good[of]] = 0
    out, own = np.concatenate([cells, between])[_ranges(at, length)], np.repeat(of, length)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (own[1:] != own[:-1])
    return np.bincount(own[keep], minlength=len(size)), out[keep]


def line(points: np.ndarray, res: int) -> np.ndarray | None:
    """The cells of ``lines`` for one line of (lon, lat); None for points that are no coordinates."""
    n, cells = lines(points[:, 0], points[:, 1], np.array([len(points)]), res)
    return cells if n[0] else None


def children(h: int, res: int) -> np.ndarray:
    """All descendants of a cell at a finer resolution."""
    out = np.array([h], np.int64)
    for r in range(int(G.resolution(h)) + 1, res + 1):
        s = (G.MAX_RES - r) * 3
        head = (out & ~np.int64(15 << 52) & ~np.int64(7 << s)) | np.int64(r << 52)
        out = (head[:, None] | (np.arange(7, dtype=np.int64) << s)[None, :]).ravel()
        out = out[G.is_valid(out)]
    return out


def compact(cells) -> np.ndarray:
    """Complete sets of siblings merged into their parents, as far as it goes."""
    left, out = np.unique(np.asarray(cells, np.int64)), []
    for res in range(15, 0, -1):
        own = left[G.resolution(left) == res]
        rest = left[G.resolution(left) != res]
        s = (G.MAX_RES - res) * 3
        parent = (own & ~np.int64(15 << 52)) | np.int64((res - 1) << 52) | np.int64(7 << s)
        up, which, n = np.unique(parent, return_inverse=True, return_counts=True)
        full = n == np.where(G.is_pentagon(up), 6, 7) if len(up) else np.zeros(0, bool)
        out.append(own[~full[which]])
        left = np.union1d(rest, up[full])
    return np.concatenate([*out, left])
