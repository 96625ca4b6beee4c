"""Topological vertices: each belongs to the lowest of the cells that meet there, and is numbered in its boundary."""

from __future__ import annotations

import numpy as np

from hexloom.kernel import grid as G

_MODE = np.int64(4 << 59)
_HEAD = np.int64(~(127 << 56))


def ring_arrays(h) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries without the points that only edges of the icosahedron add: the number of vertices, 6 or 5 for a
    pentagon, and the vertices, shape (n, 6, 2), nan beyond that number."""
    h = np.asarray(h, np.int64)
    size, points = G.boundaries(h)
    n = np.where(G.is_pentagon(h), 5, 6)
    while (size > n).any():
        for m in np.unique(size[size > n]).tolist():
            at = np.flatnonzero((size == m) & (size > n))
            p = _xyz(points[at, :m])
            back, ahead = np.roll(p, 1, axis=1) - p, np.roll(p, -1, axis=1) - p
            length = np.linalg.norm(back, axis=2) * np.linalg.norm(ahead, axis=2)
            least = (np.linalg.norm(np.cross(back, ahead), axis=2) / length).argmin(axis=1)
            keep = np.arange(m) != least[:, None]
            points[at, : m - 1] = points[at, :m][keep].reshape(len(at), m - 1, 2)
            points[at, m - 1] = np.nan
            size[at] -= 1
    return n, points[:, :6]


def rings(h) -> list[np.ndarray]:
    """The vertices of ``ring_arrays`` of each cell."""
    return [p[:n] for n, p in zip(*ring_arrays(h), strict=True)]


def _xyz(points: np.ndarray) -> np.ndarray:
    return G.xyz(np.radians(points[..., 1]), np.radians(points[..., 0]))


#: Cells that are compared with their neighbours at a time.
SLICE = 2048


def id_arrays(h) -> tuple[np.ndarray, np.ndarray]:
    """The number of vertices of each cell, and their ids in order of its boundary, shape (n, 6), 0 beyond that number."""
    own, which = np.unique(np.asarray(h, np.int64), return_inverse=True)
    size, ids = np.zeros(len(own), np.int64), np.zeros((len(own), 6), np.int64)
    for lo in range(0, len(own), SLICE):
        part = slice(lo, lo + SLICE)
        size[part], ids[part] = _of_some(own[part])
    return size[which], ids[which]


def of_cells(h) -> list[np.ndarray]:
    """The ids of ``id_arrays`` of each cell."""
    return [v[:n] for n, v in zip(*id_arrays(h), strict=True)]


def _of_some(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    met = np.concatenate([own[:, None], G.neighbors(own)], axis=1)
    every, at = np.unique(met, return_inverse=True)
    at = at.reshape(met.shape)
    n, points = ring_arrays(every[every != 0])
    pad = int((every == 0).sum())  # a pentagon has no neighbour in direction 1
    n, points = np.concatenate([np.zeros(pad, np.int64), n]), np.concatenate([np.full((pad, 6, 2), np.nan), points])
    p = _xyz(points)
    ring = p[at[:, 0]]
    reach = 0.2 * np.sqrt(((ring[:, 0] - ring[:, 1]) ** 2).sum(axis=1))
    owner, number = np.repeat(own[:, None], 6, axis=1), np.tile(np.arange(6), (len(own), 1))
    for k in range(1, 7):
        d = np.sqrt(((p[at[:, k]][:, None] - ring[:, :, None]) ** 2).sum(axis=3))
        d = np.where(np.isnan(d), np.inf, d)
        lower = (d.min(axis=2) < reach[:, None]) & (met[:, k, None] < owner)
        owner, number = np.where(lower, met[:, k, None], owner), np.where(lower, d.argmin(axis=2), number)
    size = n[at[:, 0]]
    ids = (owner & _HEAD) | _MODE | (number.astype(np.int64) << 56)
    return size, np.where(np.arange(6) < size[:, None], ids, 0)


def owner(v) -> np.ndarray:
    return (np.asarray(v, np.int64) & _HEAD) | np.int64(1 << 59)


def to_lonlat(v) -> np.ndarray:
    """(lon, lat) of vertices."""
    v = np.asarray(v, np.int64)
    own, which = np.unique(owner(v), return_inverse=True)
    return ring_arrays(own)[1][which, (v >> 56) & 7]


def is_valid(v) -> np.ndarray:
    """Whether ids are vertices: the owner is a cell, and the vertex of that number is its own."""
    v = np.asarray(v, np.int64)
    own = owner(v)
    good = (v > 0) & ((v >> 59) == 4) & G.is_valid(own)
    good[good] = (id_arrays(own[good])[1] == v[good, None]).any(axis=1)
    return good
