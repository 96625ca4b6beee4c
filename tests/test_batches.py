"""Arrow functions work on whole batches: what Python calls doesn't grow with the rows."""

import json
import sys
import tracemalloc

import numpy as np
import pyarrow as pa

from hexloom.functions import geo as X
from hexloom.kernel import cells as C
from hexloom.kernel import grid as G
from hexloom.kernel import polygons as P
from hexloom.kernel import shapes as S
from hexloom.plans import inner, registry

SF = "/root/testdata/sf0.001"


def cells(n, res=4, seed=5):
    r = np.random.default_rng(seed)
    return G.from_lonlat(r.uniform(-180, 180, n), np.degrees(np.arcsin(r.uniform(-1, 1, n))), res)


def calls(run, *arguments):
    """Calls of Python and C functions."""
    count = 0

    def see(frame, event, arg):
        nonlocal count
        count += event in ("call", "c_call")

    sys.setprofile(see)
    try:
        run(*arguments)
    finally:
        sys.setprofile(None)
    return count


def apart(h, steps=5):
    for way in range(steps):
        near = G.neighbors(h)
        h = near[np.arange(len(h)), 1 + way % 2]
    return h


def test_paths_of_a_batch():
    a = cells(2000)
    b = apart(a)
    assert calls(X._path, pa.array(a), pa.array(b)) < 20_000
    n, every = C.paths(a, b)
    for k, p in enumerate(np.split(every, np.cumsum(n)[:-1])[:300]):
        assert p[0] == a[k] and p[-1] == b[k] and len(p) == C.distances(a[k : k + 1], b[k : k + 1])[0] + 1
    assert X._unbroken(pa.array([[int(a[0])], [int(a[0]), int(b[0])], None, []])).to_pylist() == [True, False, None, True]
    assert all(X._unbroken(X._path(pa.array(a), pa.array(b))).to_pylist())


def test_costly_rows_are_dealt_out(spark):
    """A small file of one row group isn't one task's work."""
    assert inner.inner_cells(spark, SF).rdd.getNumPartitions() > 1


def test_lines_of_a_batch():
    a = cells(1500)
    x, y = (np.stack(v, axis=1).ravel() for v in zip(G.to_lonlat(a), G.to_lonlat(apart(a)), strict=True))
    points = pa.ListArray.from_arrays(pa.array(np.arange(0, 3001, 2, dtype=np.int32)), X._points(np.stack([x, y], axis=1)))
    assert calls(X._line, points, 4) < 30_000
    got = X._line(pa.concat_arrays([points, pa.array([None, [], [{"x": 1.0, "y": None}]], points.type)]), 4).to_pylist()
    assert got[-3:] == [None, None, None]
    for k in range(0, 1500, 50):
        assert got[k] == C.line(np.stack([x[2 * k : 2 * k + 2], y[2 * k : 2 * k + 2]], axis=1), 4).tolist()


def test_dissolved_groups_of_a_batch():
    h = cells(1500)
    o, near, k = G.disk_distances(h, 1)
    size = np.bincount(o[k == 1], minlength=len(h))
    rings = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(near[k == 1]))
    assert calls(X._dissolve, rings, False) < 20_000
    got = X._dissolve(pa.concat_arrays([rings, pa.array([None, []], rings.type)]), False).to_pylist()
    assert got[-2:] == [None, []]
    for k in range(0, 1500, 100):
        alone = S.dissolve(np.array(rings[k].as_py()))
        assert got[k] == [[[{"x": x, "y": y} for x, y in ring] for ring in p] for p in alone]


def test_vertexes_of_a_batch():
    h = np.concatenate([cells(1500), G.pack(G.PENTAGONS, np.zeros((5, 12), np.int64), 5)])
    ids = X._vertex_ids(pa.array(h))
    assert calls(X._vertex_ids, pa.array(h)) < 20_000 and ids.value_lengths().to_pylist()[-12:] == [5] * 12
    v = ids.flatten()
    assert calls(X._vertex_to_lonlat, v) < 20_000 and calls(X._valid_vertex, v) < 20_000
    assert X._valid_vertex(pa.concat_arrays([v, pa.array([0, None, int(h[0])], pa.int64())])).to_pylist() == [True] * len(v) + [False, None, False]
    ring = X._vertexes(pa.array(h)).flatten()
    far = [np.abs(X._vertex_to_lonlat(v).field(k).to_numpy() - ring.field(k).to_numpy()) for k in (0, 1)]
    assert far[1].max() < 1e-9 and np.minimum(far[0], 360 - far[0]).max() < 1e-9


def test_region_join_sends_no_side_to_all_tasks(spark):
    """Whatever Spark's estimates are: small files may hold very many rows."""
    plan = inner.region_join(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_cells_around_polygons():
    ring = [{"x": x, "y": y} for x, y in ((0.0, 0.0), (3.0, 0.0), (3.0, 2.0), (0.0, 2.0))]
    p = pa.array([[ring], None], pa.list_(pa.list_(X._POINT)))
    near = G.disk_distances(np.array(X._polygon_cells_touching(p, 3).to_pylist()[0]), 1)[1]
    assert X._polygon_cells_around(p, 3).to_pylist() == [np.unique(near).tolist(), None]


def test_geometries_of_a_batch():
    lon, lat = G.to_lonlat(cells(1200))
    x, y = lon * 0.9, lat * 0.9
    texts = []
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        point, line = {"type": "Point", "coordinates": [a, b]}, {"type": "LineString", "coordinates": [[a, b], [a + 0.5, b]]}
        texts.append(json.dumps((point, line, {"type": "GeometryCollection", "geometries": [point, line]})[k % 3]))
    assert calls(X._geometry_cells, pa.array(texts), 4, False, "geojson") < 100 * len(texts)
    got = X._geometry_cells(pa.array([*texts, None, "{}"]), 4, False, "geojson").to_pylist()
    assert got[-2:] == [None, None] and got[0] == G.from_lonlat(x[:1], y[:1], 4).tolist()
    assert all(got[k] == sorted(set(C.line(np.array([(x[k], y[k]), (x[k] + 0.5, y[k])]), 4).tolist())) for k in range(2, 200, 3))


def edges():
    return np.concatenate([(cells(500) & ~np.int64(127 << 56)) | np.int64(2 << 59) | np.int64(way << 56) for way in range(1, 7)])


def test_edge_lengths_of_a_batch():
    e = edges()
    assert calls(X._edge_length, pa.array(e)) < 10_000
    got = X._edge_length(pa.concat_arrays([pa.array(e), pa.array([None, 55], pa.int64())])).to_pylist()
    assert got[-2:] == [None, None]
    assert all(abs(got[k] - C.edge_lengths_rads(C.edge_reversed(e[k : k + 1]))[0]) < 1e-12 for k in range(0, len(e), 300))


def test_edge_boundaries_of_a_batch():
    e = edges()
    assert calls(X._edge_boundary, pa.array(e)) < 10_000
    there, back = (X._edge_boundary(pa.array(v)).to_pylist() for v in (e, C.edge_reversed(e)))
    assert all(len(p) >= 2 and abs(p[0]["y"] - q[-1]["y"]) < 1e-9 and abs(p[-1]["y"] - q[0]["y"]) < 1e-9 for p, q in zip(there, back, strict=True))


def test_disks_on_a_face_are_not_searched(monkeypatch):
    h, asked = cells(2000, 13), []
    neighbors = G.neighbors
    monkeypatch.setattr(G, "neighbors", lambda c: asked.append(len(c)) or neighbors(c))
    o, c, k = G.disk_distances(h, 3)
    assert sum(asked) < len(h) and (np.bincount(o) == 37).all() and np.array_equal(h, c[k == 0])
    ring = G.disk_distances(h, 3, 3)
    assert np.array_equal(ring[1], c[k == 3]) and np.array_equal(ring[0], o[k == 3])
    five = cells(300, 2)
    assert all(np.array_equal(*v) for v in zip(G.disk_distances(five, 3), G._searched(five, 3), strict=True))


def test_disk_sizes_are_dealt_out(spark):
    assert registry.grid_disk_sizes(spark, SF).rdd.getNumPartitions() > 1


def test_polygon_estimates_are_dealt_out(spark):
    assert registry.polyfill_estimate(spark, SF).rdd.getNumPartitions() > 1


def test_memory_of_polygons_follows_slices_not_batches():
    ring = np.array([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])

    def peak(n):
        lon, lat = G.to_lonlat(cells(n))
        xy = (np.stack([lon, lat], axis=1)[:, None] * 0.9 + ring).reshape(-1, 2)
        end = np.arange(4, 4 * n + 1, 4)
        p = P.Polygons.of_rings(np.arange(n), end - 4, end, xy[:, 0], xy[:, 1], n)
        tracemalloc.start()
        P.cells_of(p, 3, touching=True)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(6000) < 1.7 * peak(2000)
