"""Operators on small frames, with the reference vectors' outcomes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexloom.functions import bits as B
from hexloom.functions import geo as X
from hexloom.kernel import cells as C
from hexloom.kernel import grid as G
from hexloom.operators import collections as CO
from hexloom.operators import frame as FR
from hexloom.operators import graph as GR
from hexloom.operators import raster as RA
from hexloom.operators import routing as RO
from hexloom.operators import spatial as SP
from hexloom.sources import files, osm


def cell(lon, lat, r):
    return int(G.from_lonlat([lon], [lat], r)[0])


def disk(lon, lat, r, k):
    return G.disk_distances([cell(lon, lat, r)], k)[1].tolist()


def frame(spark, cells, **values):
    names = list(values)
    rows = [(c, *(v[i] if isinstance(v, list) else v for v in values.values())) for i, c in enumerate(cells)]
    return spark.createDataFrame(rows, "cell long" + "".join(f", {n} int" for n in names))


def test_bits_on_literals(spark):
    df = spark.createDataFrame([(0x8518607BFFFFFFF,)], "c long")
    r = df.select(B.direction("c").alias("own"), B.direction_to_parent("c").alias("up"), B.direction_at("c", 1).alias("one"), B.to_hex("c").alias("hex")).first()
    assert (r.own, r.up, r.one, r.hex) == (6, 3, 1, "8518607bfffffff")
    df = spark.createDataFrame([(0x861EA54F7FFFFFF,), (0x149283080DDBFFFF,)], "c long")
    assert [r[0] for r in df.select(B.directions("c")).collect()] == [[2, 4, 5, 2, 3, 6], [0, 6, 0, 4, 0, 1, 5, 6, 6]]


def test_valid_and_resolution_of_nullable(spark):
    df = frame(spark, [cell(4.5, 1.3, 6), 55, None])
    got = df.select(B.is_valid("cell").alias("v"), B.resolution("cell").alias("r")).collect()
    assert [(r.v, r.r) for r in got] == [(True, 6), (False, None), (None, None)]
    assert FR.all_valid(df, "cell").first()[0] is False
    assert FR.all_valid(df.limit(0), "cell").first()[0] is True


def test_parsing(spark):
    c = cell(23.3, 12.3, 6)
    df = spark.createDataFrame([(s,) for s in ("89283080ddbffff", "617700169518678015", "23.3,12.3,6", " 23.3 ; 12.3 ;6 tail", "nothing", None, "23.3,12.3,99")], "s string")
    got = [r[0] for r in df.select(B.from_string("s")).collect()]
    assert got == [0x89283080DDBFFFF, 617700169518678015, c, c, None, None, None]


def test_compaction_round_trip(spark):
    cells = disk(10, 20, 8, 10) + disk(45, 45, 8, 3)
    df = frame(spark, cells, value=5)
    small = FR.compact(df, "cell")
    assert small.columns == ["value", "cell"] and small.count() < len(cells)
    assert {r.cell for r in FR.uncompact(small, "cell", 8).collect()} == set(cells)
    grouped = FR.compact(df, "cell", exploded=False)
    assert grouped.count() == 1 and len(grouped.first().cell) == small.count()


def test_compaction_of_mixed_and_invalid(spark):
    c = cell(23.3, 12.3, 5)
    kids = C.children(c, 7).tolist()
    df = frame(spark, [*kids[:10], c, kids[0], 55, None])
    assert [r.cell for r in FR.compact(df, "cell").collect()] == [c]
    pent = int(G.pack(np.array([14]), np.zeros((1, 1), int), 1)[0])
    assert [r.cell for r in FR.compact(frame(spark, C.children(pent, 2).tolist()), "cell").collect()] == [pent]
    assert FR.compact(frame(spark, [55]), "cell").count() == 0


def test_uncompact_subset(spark):
    df = frame(spark, disk(12, 12, 5, 12), value=1)
    centre = int(df.select(B.center_child(F.lit(cell(12, 12, 5)), 7)).first()[0])
    subset = spark.createDataFrame([(int(c),) for c in G.disk_distances([centre], 1)[1]], "w long")
    out = FR.uncompact_subset(df, "cell", 7, subset, "w")
    assert out.count() == 7 and out.columns == ["value", "cell"]


def test_partition_by_resolution(spark):
    df = frame(spark, [cell(45.6, -45.8, 7), cell(45.6, -10.2, 8), cell(45.6, 50.2, 8), cell(-23.1, -60.5, 5), 55, None])
    assert {r: p.count() for r, p in FR.partition_by_resolution(df, "cell").items()} == {5: 1, 7: 1, 8: 2}


def test_change_resolution(spark):
    c = cell(23.3, 12.3, 6)
    df = frame(spark, [c])
    assert [FR.change_resolution(df, "cell", r).count() for r in (5, 6, 7)] == [1, 1, 7]


def test_clusters(spark):
    df = frame(spark, disk(12.2, 14.5, 6, 3) + disk(42.2, 45.5, 6, 2), value=[1] * 37 + [5] * 19)
    got = FR.clusters(df, "cell").collect()
    assert sorted(len(r.cells) for r in got) == [19, 37] and sorted(r.cluster_num for r in got) == [0, 1]
    by = {r.value: len(r.cells) for r in FR.clusters(df, "cell", "value").collect()}
    assert by == {1: 37, 5: 19}


def test_neighbor_values(spark):
    cells = disk(12.3, 45.4, 6, 2)
    df = frame(spark, cells, value=6)
    got = FR.neighbor_values(frame(spark, cells[:1]), df, "cell", "value", 1, 1).collect()
    assert len(got) == 6 and {r.neighbor_value for r in got} == {6}
    one = frame(spark, cells[:1], value=4)
    got = FR.neighbor_values(one, one, "cell", "value", 1, 1, 6).collect()
    assert len(got) == 6 and {r.neighbor_value for r in got} == {6}
    assert FR.neighbor_values(one, one.limit(0), "cell", "value", 1, 1).count() == 0


def test_edges_around(spark):
    c = cell(12.3, 45.4, 6)
    df = frame(spark, [c]).select(F.element_at(B.outgoing_edges("cell"), 1).alias("edge"))
    assert df.select(F.size(FR.following_edges("edge"))).first()[0] == 5
    assert FR.previous_edges(df, "edge").count() == 5


def test_sets_and_blocks(spark):
    a, b = frame(spark, disk(10, 10, 5, 2)), frame(spark, disk(10, 10, 5, 1))
    assert CO.is_subset(b, a, "cell").first()[0] and not CO.is_superset(b, a, "cell").first()[0]
    assert not CO.is_disjoint(a, b, "cell").first()[0]
    fine = frame(spark, C.children(cell(10, 10, 5), 7).tolist()[:3] + [cell(80, 10, 7)])
    assert CO.contains(a, fine, "cell").count() == 3
    for k in (1, 8, 50):
        ids = np.array(disk(-122, 37, 9, k))
        assert (CO.unpack_block(CO.pack_block(ids)) == ids).all()
    with pytest.raises(CO.DecompressionError):
        CO.rle_decode(b"abc")


def test_spatial_masks(spark):
    df = frame(spark, [cell(45.5, 45.5, 7), cell(-60.5, -60.5, 7), cell(120.5, 70.5, 7), 55])
    for by in ("point", "rect"):
        got = SP.geometries_intersect(df, "cell", [SP.rect(40, 40, 50, 50)], "hit", by).collect()
        assert [r.hit for r in got] == [True, False, False, None]
    donut = [*SP.rect(40, 40, 50, 50), *SP.rect(45, 45, 46, 46)]
    assert SP.geometries_intersect(df, "cell", [donut], "hit", "point").first().hit is False
    assert SP.geometries_intersect(df, "cell", [donut], "hit", "point", refine=False).first().hit is True
    near = SP.with_coordinate(df, "cell").select(SP.point_within("x", "y", (-60.0, -60.0), 2.0).alias("w")).collect()
    assert [r.w for r in near] == [False, True, False, None]


def test_region_join(spark):
    cells = frame(spark, disk(12.31, 45.4, 8, 8))
    region = [[{"x": x, "y": y} for x, y in ((12.28, 45.35), (12.35, 45.35), (12.35, 45.45), (12.28, 45.45), (12.28, 45.35))]]
    regions = spark.createDataFrame([(1, region)], f"region int, polygon {X.POLYGON}")
    got = {r.cell for r in SP.region_join(cells, "cell", regions, "polygon", 5).collect()}
    flat = cells.select("cell", X.to_lonlat("cell").alias("p")).filter("p.x > 12.28 AND p.x < 12.35 AND p.y > 45.35 AND p.y < 45.45")
    assert got == {r.cell for r in flat.collect()} and got


def test_raster_resolution_and_transform():
    rio = RA.Transform.from_rasterio((0.0011965049999999992, 0.0, 8.11377, 0.0, -0.001215135, 49.40792))
    gdal = RA.Transform.from_gdal((8.11377, 0.0011965049999999992, 0.0, 49.40792, 0.0, -0.001215135))
    assert rio == gdal
    assert RA.nearest_resolution((2000, 2000), gdal) == 10
    assert RA.nearest_resolution((2000, 2000), gdal, mode="smaller_than_pixel") == 11
    x, y = gdal.invert().apply(*gdal.apply(100, 200))
    assert (x, y) == (pytest.approx(100), pytest.approx(200))
    with pytest.raises(RA.TransformNotInvertible):
        RA.Transform(1, 2, 0, 2, 4, 0).invert()


def test_raster_to_cells(spark):
    t = RA.Transform.from_gdal((11.0, 1.0, 0.0, 10.0, 1.2, 0.2))
    rows = [(0, 0, float("nan")), (0, 1, 1.0), (1, 0, float("nan")), (1, 1, 1.0)]
    px = spark.createDataFrame(rows, "row int, col int, value double")
    out = RA.to_cells(px, (2, 2), t, 4, axis="xy", compact=False)
    found = {str(r.value) for r in out.select("value").distinct().collect()}
    assert found == {"nan", "1.0"}
    assert RA.to_cells(px, (2, 2), t, 4, nodata=1.0, axis="xy").select("value").distinct().count() == 1


def test_data_boxes():
    g = np.zeros((9, 12), int)
    g[1:3, 1:4] = g[5:8, 6:9] = 1
    assert RA.data_boxes(g, 0) == [(1, 2, 1, 3), (5, 7, 6, 8)]


def line_graph(spark, r=4, weight=10):
    cells = C.line(np.array([(10.0, 20.0), (20.0, 20.0)]), r).tolist()
    rows = [(int(C.edge_to([a], [b])[0]), weight) for a, b in zip(cells[:-1], cells[1:], strict=True)]
    return cells, GR.from_edges(spark.createDataFrame(rows, "edge long, weight long"))


def test_graph_basics(spark):
    cells, g = line_graph(spark)
    s = GR.stats(g).first()
    assert (s.h3_resolution, s.num_nodes, s.num_edges) == (4, len(cells), len(cells) - 1)
    types = {r.cell: r.node_type for r in GR.nodes(g).collect()}
    assert types[cells[0]] == 1 and types[cells[-1]] == 2 and types[cells[1]] == 3
    down = GR.downsample(g, 2)
    assert 0 < down.count() < g.count()
    assert GR.exclude_cells(g, frame(spark, [cells[3]]), "cell").count() == g.count() - 2


def test_long_edges(spark):
    _, g = line_graph(spark)
    p = GR.prepare(g)
    c = GR.counts(p).first()
    assert (c.edges, c.longedges) == (g.count(), 1)
    assert GR.non_overlapping(p).count() == 1
    long = p.filter("longedge IS NOT NULL").first().longedge
    assert len(long.path) == g.count() and long.weight == 10 * g.count()


def test_within_threshold(spark):
    cells, g = line_graph(spark)
    got = {r.cost for r in RO.within_threshold(g, frame(spark, cells[:1]), "cell", 30).collect()}
    assert got == {0, 10, 20, 30}
    origins = frame(spark, [cells[0], cells[1], cells[10]])
    many = RO.within_threshold_many(g, origins, "cell", 30).collect()
    assert len(many) == 9 and sorted(r.cost for r in many) == [0, 0, 0, 10, 10, 20, 20, 30, 30]


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_shortest_paths(spark, monkeypatch, sent):
    monkeypatch.setattr(RO, "SENT_EDGES", sent)
    cells, g = line_graph(spark)
    out = RO.shortest_paths(g, frame(spark, cells[:1]), "cell", frame(spark, [cells[0], cells[4]]), "cell").collect()
    assert sorted((r.cost, len(r.edges)) for r in out) == [(0, 0), (40, 4)]
    one = RO.shortest_paths(g, frame(spark, cells[:1]), "cell", frame(spark, [cells[3], cells[4]]), "cell", RO.Options(num_destinations_to_reach=1)).collect()
    assert [r.cost for r in one] == [30]
    walk = RO.path_cells(RO.shortest_paths(g, frame(spark, cells[:1]), "cell", frame(spark, [cells[4]]), "cell")).first()
    assert walk.cells == cells[:5]


def test_snapping_and_errors(spark):
    cells, g = line_graph(spark)
    off = [c for c in G.disk_distances([cells[0]], 1)[1].tolist() if c not in cells][:1]
    far = RO.shortest_paths(g, frame(spark, off), "cell", frame(spark, [cells[4]]), "cell", RO.Options(max_distance_to_graph=1)).collect()
    assert [(r.origin, r.destination) for r in far] == [(off[0], cells[4])]
    with pytest.raises(RO.DestinationsNotInGraph):
        RO.shortest_paths(g, frame(spark, cells[:1]), "cell", frame(spark, off), "cell")
    diff = RO.differential(g, frame(spark, cells[:1]), "cell", frame(spark, [cells[1], cells[4]]), "cell", frame(spark, [cells[3]]), "cell").first()
    assert len(diff.before) == 2 and len(diff.after) == 1


def test_nearest_nodes(spark):
    c = 0x89283080DDBFFFF
    _, near, k = G.disk_distances([c], 5)
    nodes = spark.createDataFrame([(int(x), 3) for x in [*near[k == 2][:2], *near[k == 4][:2]]], "cell long, node_type int")
    got = GR.nearest_nodes(frame(spark, [c]), "cell", nodes, 5).collect()
    assert len(got) == 2 and {r.k for r in got} == {2}


def test_road_graph(spark):
    nodes = spark.createDataFrame([(1, 10.0, 20.0), (2, 10.3, 20.0), (3, 10.3, 20.3)], osm.NODES)
    ways = spark.createDataFrame([(1, [1, 2, 99], {"highway": "primary"}), (2, [2, 3], {"highway": "residential", "oneway": "yes"}), (3, [1, 3], {"building": "yes"})], osm.WAYS)
    g = osm.road_graph(nodes, ways, 6)
    assert {r.weight for r in g.select("weight").distinct().collect()} == {3.0, 8.0}
    two_way = g.filter("weight = 3.0").count()
    assert two_way % 2 == 0 and two_way > 0


def test_pbf(spark, tmp_path):
    import struct
    import zlib

    def var(n):
        out = b""
        while True:
            n, b = n >> 7, n & 127
            out += bytes([b | (128 if n else 0)])
            if not n:
                return out

    zig = lambda n: var((n << 1) ^ (n >> 63))
    part = lambda n, body: var(n << 3 | 2) + var(len(body)) + body
    strings = b"".join(part(1, s) for s in (b"", b"highway", b"primary"))
    dense = part(1, zig(5) + zig(1)) + part(8, zig(200000000) + zig(10)) + part(9, zig(100000000) + zig(20))
    way = var(1 << 3) + var(7) + part(2, var(1)) + part(3, var(2)) + part(8, zig(5) + zig(1))
    block = part(1, strings) + part(2, part(2, dense) + part(3, way))
    blob = part(3, zlib.compress(block))
    head = part(1, b"OSMData") + var(3 << 3) + var(len(blob))
    (tmp_path / "x.pbf").write_bytes(struct.pack(">I", len(head)) + head + blob)
    nodes, ways = osm.read_pbf(spark, str(tmp_path / "x.pbf"))
    assert [(r.id, round(r.lon, 6), round(r.lat, 6)) for r in nodes.collect()] == [(5, 10.0, 20.0), (6, 10.000002, 20.000001)]
    assert [(r.id, r.refs, r.tags) for r in ways.collect()] == [(7, [5, 6], {"highway": "primary"})]


def test_sinks(spark, tmp_path):
    cells, g = line_graph(spark)
    files.save_graph(g, str(tmp_path / "g"))
    assert files.load_graph(spark, str(tmp_path / "g")).count() == g.count()
    files.save_geojson(frame(spark, cells[:2]), "cell", str(tmp_path / "j"))
    assert '"Polygon"' in spark.read.text(str(tmp_path / "j")).first()[0]
    files.save_cells(frame(spark, cells), "cell", str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == len(cells)
    ring = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]
    assert files.polygon_from_wkb(files.polygon_to_wkb(ring)) == ring


def test_stream(spark, tmp_path):
    from hexloom.streaming import rollup

    rows = [(cell(10, 20, 7), "2024-01-01 00:01:00"), (cell(10, 20, 7), "2024-01-01 00:02:00"), (None, "2024-01-01 00:03:00")]
    spark.createDataFrame(rows, "cell long, ts string").selectExpr("cell", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("cell long, ts timestamp").parquet(str(tmp_path / "in"))
    q = rollup.windowed_parents(s, "cell", "ts", 5).writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.n for r in spark.sql("SELECT n FROM rolled").collect()] == [2]


def test_lines_and_bounds(spark):
    cells, g = line_graph(spark)
    e = g.withColumn("p", F.monotonically_increasing_id())
    assert FR.bounding_rect(frame(spark, cells), "cell").first().x0 < 10
    seq = spark.createDataFrame([(i, int(C.edge_to([a], [b])[0])) for i, (a, b) in enumerate(zip(cells[:4], cells[1:5], strict=True)) if i != 2], "p int, edge long").withColumn("k", F.lit(0))
    lines = FR.edges_to_lines(seq, "edge", "p", ["k"]).collect()
    assert sorted(len(r.points) for r in lines) == [2, 3]
    assert GR.bounding_rect(g).first().x1 > 19 and len(GR.concave_hull(g)) > 3
    assert len(GR.covered_area(g, 1).first().polygons) == 1
    _ = e


def test_frame_wrapper(spark):
    df = frame(spark, [cell(1, 1, 5), 55])
    with pytest.raises(FR.InvalidCells):
        FR.CellFrame(df, "cell")
    w = FR.CellFrame(df, "cell", validate=False).filter_valid()
    assert w.resolution().df.first().h3_res == 5 and w.uncompact(6).df.count() == 7


def test_region_join_keeps_repeated_rows_and_regions(spark):
    cells = frame(spark, [cell(12.31, 45.4, 8)] * 2)
    ring = [[{"x": x, "y": y} for x, y in ((12.28, 45.35), (12.35, 45.35), (12.35, 45.45), (12.28, 45.45))]]
    far = [[{"x": p["x"] + 9, "y": p["y"]} for p in ring[0]]]
    regions = spark.createDataFrame([(1, ring), (1, ring), (1, far), (2, None)], f"region int, polygon {X.POLYGON}")
    assert SP.region_join(cells, "cell", regions, "polygon", 5).count() == 4


def test_polygons_together_against_one_by_one(spark):
    from hexloom.kernel import shapes as S

    rng = np.random.default_rng(3)
    polygons = []
    for k in range(60):
        x, y = rng.uniform(-170, 170), rng.uniform(-80, 80)
        turn = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 9)))
        outer = [(x + np.cos(t) * (0.2 + k / 40), y + np.sin(t) * (0.2 + k / 40)) for t in turn]
        hole = [(x + 0.05, y + 0.05), (x - 0.05, y + 0.05), (x - 0.05, y - 0.05)]
        polygons.append([outer, hole] if k % 3 == 0 else [outer, [(x, y)]] if k % 3 == 1 else [outer + outer[:1]])
    rows = [(k, [[{"x": float(a), "y": float(b)} for a, b in r] for r in p]) for k, p in enumerate(polygons)] + [(100, None), (101, []), (102, [[{"x": 1.0, "y": 2.0}]])]
    df = spark.createDataFrame(rows, f"k int, p {X.POLYGON}")
    for res in (4, 5):
        got = {r.k: r for r in df.select("k", X.polygon_cells("p", res).alias("a"), X.polygon_cells_touching("p", res).alias("t"), X.max_polygon_cells("p", res).alias("most")).collect()}
        for k, p in enumerate(polygons):
            assert got[k].a == S.polygon_cells(p, res).tolist() and got[k].t == S.polygon_cells_touching(p, res).tolist()
            assert len(got[k].a) <= got[k].most
        assert got[100].a is None and got[101].a == [] and got[102].t == []
    dealt = FR.polygon_cells(df, "p", 5).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in dealt} == {k: len(S.polygon_cells(p, 5)) for k, p in enumerate(polygons) if len(S.polygon_cells(p, 5))}


def test_plans_stay_short(spark):
    """A cell that is an expression isn't copied into every use without bound."""
    from hexloom.plans import inputs as I

    ids = I.mixed_ids(spark, "/root/testdata/sf0.001")
    size = lambda df: len(df._jdf.queryExecution().executedPlan().toString())
    assert size(FR.filter_valid(ids, "cell")) < 12_000
    assert size(I.lineitem_cells(spark, "/root/testdata/sf0.001").select(B.from_hex(B.to_hex("cell")))) < 6_000


def test_geometries_of_all_kinds(spark):
    import json

    from hexloom.kernel import geometry as Q
    from hexloom.kernel import shapes as S

    square = lambda x, y: [[[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]]
    line, point = [[0.0, 0.0], [2.0, 1.0]], [5.0, 5.0]
    own = {
        "Point": (point, {cell(5, 5, 5)}),
        "MultiPoint": ([point, [7.0, 7.0], point], {cell(5, 5, 5), cell(7, 7, 5)}),
        "LineString": (line, set(C.line(np.array(line), 5).tolist())),
        "MultiLineString": ([line, [[9.0, 9.0], [9.5, 9.0]]], {*C.line(np.array(line), 5).tolist(), *C.line(np.array([[9.0, 9.0], [9.5, 9.0]]), 5).tolist()}),
        "Polygon": (square(10.0, 10.0), set(S.polygon_cells([np.array(square(10, 10)[0], float)], 5).tolist())),
        "MultiPolygon": ([square(10.0, 10.0), square(10.5, 10.5)], {*S.polygon_cells([np.array(square(10, 10)[0], float)], 5).tolist(), *S.polygon_cells([np.array(square(10.5, 10.5)[0], float)], 5).tolist()}),
    }
    rows = [(k, json.dumps({"type": k, "coordinates": v}), Q.to_wkb((k, v))) for k, (v, _) in own.items()]
    parts = [{"type": k, "coordinates": v} for k, (v, _) in own.items()]
    nested = {"type": "GeometryCollection", "geometries": [{"type": "GeometryCollection", "geometries": parts[:3]}, *parts[3:]]}
    rows.append(("all", json.dumps({"type": "Feature", "geometry": nested}), Q.to_wkb(Q.from_geojson(json.dumps(nested)))))
    rows += [("none", None, None), ("bad", '{"type": "Ball"}', b"\x01\x02"), ("empty", '{"type": "MultiPoint", "coordinates": []}', Q.to_wkb(("MultiPoint", [])))]
    df = spark.createDataFrame(rows, "k string, g string, w binary")
    got = {r.k: r for r in df.select("k", X.geometry_cells("g", 5).alias("a"), X.geometry_cells("w", 5, form="wkb").alias("b"), X.geometry_cells("g", 5, touching=True).alias("t")).collect()}
    for k, (_, want) in own.items():
        assert set(got[k].a) == want and got[k].b == got[k].a and want <= set(got[k].t)
    assert set(got["all"].a) == set().union(*(w for _, w in own.values())) and got["all"].b == got["all"].a
    assert got["none"].a is None and got["bad"].a is None and got["bad"].b is None and got["empty"].a == []
    assert set(got["Polygon"].t) == set(S.polygon_cells_touching([np.array(square(10, 10)[0], float)], 5).tolist())


def _tiff(values, tiled, deflate, predictor):
    import struct
    import zlib

    rows, cols = values.shape
    blocks = []
    if tiled:
        for r in range(0, rows, 16):
            for c in range(0, cols, 16):
                b = np.zeros((16, 16), values.dtype)
                part = values[r : r + 16, c : c + 16]
                b[: part.shape[0], : part.shape[1]] = part
                blocks.append(b)
    else:
        blocks = [values[r : r + 7] for r in range(0, rows, 7)]
    if predictor:
        blocks = [np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1).astype(values.dtype) for b in blocks]
    data = [zlib.compress(b.tobytes()) if deflate else b.tobytes() for b in blocks]
    at = np.cumsum([8, *map(len, data)]).tolist()
    tags = {256: ("I", [cols]), 257: ("I", [rows]), 258: ("H", [values.itemsize * 8]), 259: ("H", [8 if deflate else 1]), 277: ("H", [1]), 317: ("H", [2 if predictor else 1]), 339: ("H", [{"u": 1, "i": 2, "f": 3}[values.dtype.kind]]), 33550: ("d", [0.5, 0.25, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, 10.0, 48.0, 0.0])}
    tags |= {322: ("I", [16]), 323: ("I", [16]), 324: ("I", at[:-1]), 325: ("I", [len(d) for d in data])} if tiled else {273: ("I", at[:-1]), 278: ("I", [7]), 279: ("I", [len(d) for d in data])}
    body, entries = b"".join(data), b""
    place = 8 + len(body)
    late = b""
    top = place + 2 + 12 * len(tags) + 4
    for t, (form, v) in sorted(tags.items()):
        raw = struct.pack(f"<{len(v)}{form}", *v)
        kind = {"H": 3, "I": 4, "d": 12}[form]
        if len(raw) <= 4:
            entries += struct.pack("<HHI", t, kind, len(v)) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", t, kind, len(v), top + len(late))
            late += raw
    return b"II" + struct.pack("<HI", 42, place) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + late


@pytest.mark.parametrize(("tiled", "deflate", "predictor", "kind"), [(False, False, False, "u1"), (True, True, True, "i2"), (False, True, True, "u2"), (True, False, False, "f4")])
def test_tiff(spark, tmp_path, tiled, deflate, predictor, kind):
    from hexloom.sources import raster

    values = (np.arange(20 * 37).reshape(20, 37) * 7 % 250).astype("<" + kind)
    (tmp_path / "a.tif").write_bytes(_tiff(values, tiled, deflate, predictor))
    got = {(r.row, r.col): r.value for r in raster.read_tiff(spark, str(tmp_path)).collect()}
    assert got == {(r, c): float(values[r, c]) for r in range(20) for c in range(37)}
    ((_, shape, t, nodata),) = raster.describe(spark, str(tmp_path))
    assert shape == (20, 37) and t.apply(2, 4) == (11.0, 47.0) and nodata is None
    pixels = raster.read_tiff(spark, str(tmp_path))
    assert RA.to_cells(pixels, shape, t, 5, nodata=0.0).count() > 0
    (tmp_path / "a.tif").write_bytes(b"no image")
    with pytest.raises(Exception, match="not a TIFF"):
        raster.describe(spark, str(tmp_path))


def test_long_edges_shorten_searches_only(spark):
    """Routes over a prepared graph are those of the graph itself, with their edges in full."""
    cells = C.line(np.array([(10.0, 20.0), (20.0, 20.0)]), 4).tolist()
    side = C.line(np.array([(14.0, 24.0), (14.0, 16.0)]), 4).tolist()
    pairs = [(a, b, 10) for way in (cells, side) for a, b in zip(way[:-1], way[1:], strict=True)] + [(b, a, 11) for a, b in zip(side[:-1], side[1:], strict=True)]
    g = GR.from_cells(spark.createDataFrame(pairs, "a long, b long, w long"), "a", "b", "w")
    long = GR.prepare(g)
    assert long.filter("longedge IS NOT NULL").count() > 0
    starts = spark.createDataFrame([(cells[0],), (cells[3],), (side[0],)], "c long")
    ends = spark.createDataFrame([(cells[-1],), (cells[6],), (side[-1],), (side[2],)], "c long")
    show = lambda graph: sorted((r.origin, r.destination, r.cost, tuple(r.edges)) for r in RO.shortest_paths(graph, starts, "c", ends, "c").collect())
    assert show(long) == show(g) and len(show(g)) >= 6


def test_what_is_made_of_paths(spark):
    cells = C.line(np.array([(10.0, 20.0), (12.0, 20.0)]), 4).tolist()
    g = GR.from_cells(spark.createDataFrame([(a, b, 10) for a, b in zip(cells[:-1], cells[1:], strict=True)], "a long, b long, w long"), "a", "b", "w")
    one = lambda c: spark.createDataFrame([(c,)], "c long")
    (row,) = RO.shortest_paths_map(g, one(cells[0]), "c", one(cells[-1]), "c", RO.path_cells, RO.path_lengths, RO.path_lines).collect()
    assert row.cells == cells and row.length_m > 0 and len(row.points) == len(cells) and "edges" not in row
    (row,) = RO.differential_map(g, one(cells[0]), "c", one(cells[-1]), "c", one(cells[2]), "c", RO.path_lengths).collect()
    assert len(row.before) == 1 and row.before[0].length_m > 0 and row.after == []


def test_errors_and_strict_forms(spark):
    from hexloom.functions import errors as E

    assert E.error_of(0) is None and E.error_of(5).name == "CellInvalid" and E.error_of(99).code == 1
    with pytest.raises(E.GridError, match="ResDomain"):
        E.check_resolution(16)
    a, b, far = cell(10, 20, 5), cell(10, 20, 6), cell(60, 20, 5)
    df = spark.createDataFrame([(a, b, far), (None, None, None)], "a long, b long, far long")
    assert E.check_same_resolution(df, "a", "far") == 5 and E.check_same_resolution(df.limit(0), "a") is None
    with pytest.raises(E.GridError, match="ResMismatch"):
        E.check_same_resolution(df, "a", "b")
    with pytest.raises(Exception, match="ResMismatch"):
        df.select(E.same_resolution("a", "b")).collect()
    assert [r[0] for r in df.select(E.same_resolution("a", "far")).collect()] == [a, None]
    with pytest.raises(Exception, match="NotNeighbors"):
        df.filter("a IS NOT NULL").select(E.required(X.directed_edge("a", "far"), "NotNeighbors", "a", "far")).collect()


def test_rings_are_thinned_wherever_they_begin():
    from hexloom.kernel import shapes as S

    t = np.linspace(0, 2 * np.pi, 41)[:-1]
    ring = np.stack([np.cos(t) * (2 + np.cos(9 * t) / 5), np.sin(t)], axis=1)
    whole = S.thinned(ring, 0.01, cyclic=True)
    turned = S.thinned(np.roll(ring, 11, axis=0), 0.01, cyclic=True)
    assert 3 <= len(whole) < 41 and {tuple(p) for p in whole} == {tuple(p) for p in turned}
    line = np.array([(0, 0), (1, 0.01), (2, 0), (3, 2), (4, 0)], float)
    assert S.thinned(line, 0.1, cyclic=False).tolist() == [[0, 0], [2, 0], [3, 2], [4, 0]]
    assert len(S.thinned(line[:3], 9, cyclic=True)) == 3


def test_a_hull_of_too_many_nodes_is_an_error(spark):
    cells = C.line(np.array([(10.0, 20.0), (14.0, 22.0)]), 4).tolist()
    g = GR.from_cells(spark.createDataFrame([(a, b, 1) for a, b in zip(cells[:-1], cells[1:], strict=True)], "a long, b long, w long"), "a", "b", "w")
    with pytest.raises(GR.TooManyNodes):
        GR.concave_hull(g, most=3)
    assert len(GR.concave_hull(g, reduce_by=2, most=len(cells))) >= 3


def test_members_of_one_and_of_several_resolutions(spark):
    cells = disk(10, 20, 6, 3)
    asked = frame(spark, [*cells, cells[0], None, 55])
    up = lambda c, r: int(C.compact(C.children(c, r))[0]) if r > 6 else (c & ~(15 << 52)) | (r << 52) | ((1 << ((15 - r) * 3)) - 1)
    one = frame(spark, cells[:5])
    assert sorted(r.cell for r in CO.contains(one, asked, "cell").collect()) == sorted([*cells[:5], cells[0]])
    coarse = {up(c, 5) for c in cells[:2]}
    several = frame(spark, [*coarse, cells[-1], None])
    want = sorted(c for c in [*cells, cells[0]] if up(c, 5) in coarse or c == cells[-1])
    assert sorted(r.cell for r in CO.contains(several, asked, "cell").collect()) == want
    assert CO.contains(one.limit(0), asked, "cell").count() == 0
