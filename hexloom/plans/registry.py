"""Every query of the grid library by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexloom.functions import bits as B
from hexloom.functions import geo as X
from hexloom.operators import collections as CO
from hexloom.operators import frame as FR
from hexloom.operators import graph as GR
from hexloom.operators import raster as RA
from hexloom.operators import routing as RO
from hexloom.operators import spatial as SP
from hexloom.plans import duck as D
from hexloom.plans import inputs as I

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


CELLS, IDS, PARTS = I.LINEITEM_CELLS, I.MIXED_IDS, I.part_cells_sql()


# ---- bits ----------------------------------------------------------------------------------------------------------


@query("h3_parent_rollup", f"WITH {CELLS} SELECT {D.parent('cell', 2)} AS parent, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM cells GROUP BY 1")
def h3_parent_rollup(spark, sf):
    c = I.lineitem_cells(spark, sf).groupBy(B.parent("cell", 2).alias("parent"))
    return c.agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("h3_is_valid", f"WITH {IDS} SELECT l_orderkey, l_linenumber, {D.valid('cell')} AS valid FROM ids")
def h3_is_valid(spark, sf):
    return I.mixed_ids(spark, sf).select("l_orderkey", "l_linenumber", B.is_valid("cell").alias("valid"))


@query("h3_resolution", f"WITH {IDS} SELECT l_orderkey, l_linenumber, CASE WHEN {D.valid('cell')} THEN {D.res('cell')} END AS res FROM ids")
def h3_resolution(spark, sf):
    return I.mixed_ids(spark, sf).select("l_orderkey", "l_linenumber", B.resolution("cell").cast("int").alias("res"))


@query("h3_filter_valid", f"WITH {IDS} SELECT l_orderkey, l_linenumber, cell FROM ids WHERE {D.valid('cell')}")
def h3_filter_valid(spark, sf):
    return FR.filter_valid(I.mixed_ids(spark, sf), "cell")


@query("h3_all_valid", f"WITH {IDS} SELECT coalesce(bool_and(coalesce({D.valid('cell')}, FALSE)), TRUE) AS all_valid FROM ids")
def h3_all_valid(spark, sf):
    return FR.all_valid(I.mixed_ids(spark, sf), "cell")


@query("h3_base_cell", f"WITH {CELLS} SELECT {D.base('cell')} AS base, count(*) AS n FROM cells GROUP BY 1")
def h3_base_cell(spark, sf):
    return I.lineitem_cells(spark, sf).groupBy(B.base_cell("cell").alias("base")).agg(F.count("*").alias("n"))


@query("h3_digit", f"WITH {CELLS} SELECT {D.digit('cell', '7')} AS own, {D.digit('cell', '6')} AS above, count(*) AS n FROM cells GROUP BY 1, 2")
def h3_digit(spark, sf):
    own, above = B.direction("cell").cast("int").alias("own"), B.direction_to_parent("cell").cast("int").alias("above")
    return I.lineitem_cells(spark, sf).groupBy(own, above).agg(F.count("*").alias("n"))


@query("h3_directions", f"WITH {CELLS} SELECT l_orderkey, l_linenumber, array_to_string([{', '.join(D.digit('cell', str(r)) for r in range(1, 8))}], '') AS dirs FROM cells")
def h3_directions(spark, sf):
    return I.lineitem_cells(spark, sf).select("l_orderkey", "l_linenumber", F.array_join(B.directions("cell").cast("array<string>"), "").alias("dirs"))


@query("h3_is_pentagon", f"SELECT r_regionkey, c AS cell, {D.pentagon('c')} AS pent FROM (SELECT r_regionkey, (CAST(14 + r_regionkey % 2 AS BIGINT) << 45) | {(1 << 59) | ((1 << 45) - 1)} AS c FROM region)")
def h3_is_pentagon(spark, sf):
    c = B.base_id(F.lit(14) + F.col("r_regionkey") % 2)
    return I.table(spark, sf, "region").select("r_regionkey", c.alias("cell"), B.is_pentagon(c).alias("pent"))


@query("h3_center_child", f"WITH {PARTS} SELECT p_partkey, {D.center_child('cell', 3, 6)} AS child FROM cells")
def h3_center_child(spark, sf):
    return I.part_cells(spark, sf).select("p_partkey", B.center_child("cell", 6).alias("child"))


@query("h3_children", f"WITH {PARTS} SELECT p_partkey, unnest({D.children('cell', 3, 5)}) AS child FROM cells")
def h3_children(spark, sf):
    return I.part_cells(spark, sf).select("p_partkey", F.explode(B.children("cell", 5)).alias("child"))


@query("h3_child_pos", f"WITH {CELLS} SELECT l_orderkey, l_linenumber, {' + '.join(f'{D.digit('cell', str(r))} * {7 ** (7 - r)}' for r in range(4, 8))} AS pos FROM cells")
def h3_child_pos(spark, sf):
    return I.lineitem_cells(spark, sf).select("l_orderkey", "l_linenumber", B.child_pos("cell", 3).cast("int").alias("pos"))


@query("h3_contains", f"WITH {CELLS} SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS up, FALSE AS down FROM cells")
def h3_contains(spark, sf):
    """An ancestor holds a cell, unless (for odd lines) it is of another base cell."""
    p = B.parent("cell", 3) + F.shiftleft((F.col("l_linenumber") % 2).cast("long"), 45)
    c = I.lineitem_cells(spark, sf).withColumn("p", p)
    return c.select("l_orderkey", "l_linenumber", B.contains("p", "cell").alias("up"), F.coalesce(B.contains("cell", "p"), F.lit(False)).alias("down"))


@query("h3_change_resolution", f"WITH {PARTS} SELECT p_partkey, {D.parent('cell', 1)} AS cell FROM cells WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, unnest({D.children('cell', 3, 4)}) FROM cells WHERE p_partkey % 2 = 1")
def h3_change_resolution(spark, sf):
    c = I.part_cells(spark, sf).select("p_partkey", "cell")
    up, down = c.filter("p_partkey % 2 = 0"), c.filter("p_partkey % 2 = 1")
    return FR.change_resolution(up, "cell", 1).unionByName(FR.change_resolution(down, "cell", 4))


@query("h3_hex_format", f"WITH {CELLS} SELECT l_orderkey, l_linenumber, {D.hexed('cell')} AS hex FROM cells")
def h3_hex_format(spark, sf):
    return I.lineitem_cells(spark, sf).select("l_orderkey", "l_linenumber", B.to_hex("cell").alias("hex"))


@query("h3_hex_parse", f"WITH {CELLS} SELECT l_orderkey, l_linenumber, cell FROM cells")
def h3_hex_parse(spark, sf):
    return I.lineitem_cells(spark, sf).select("l_orderkey", "l_linenumber", B.from_hex(B.to_hex("cell")).alias("cell"))


@query("h3_partition_counts", f"WITH {PARTS}, mixed AS (SELECT cell FROM cells UNION ALL SELECT {D.parent('cell', 1)} FROM cells) SELECT {D.res('cell')} AS res, count(*) AS n FROM mixed GROUP BY 1")
def h3_partition_counts(spark, sf):
    c = I.part_cells(spark, sf).select("cell")
    both = c.unionByName(c.select(B.parent("cell", 1).alias("cell")))
    out = None
    for r, part in FR.partition_by_resolution(both, "cell").items():
        part = part.agg(F.count("*").alias("n")).select(F.lit(r).alias("res"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("h3_outgoing_edges", f"WITH {PARTS} SELECT p_partkey, d AS direction, {D.edge('cell', 'd')} AS edge FROM cells, range(1, 7) t(d)")
def h3_outgoing_edges(spark, sf):
    e = I.part_cells(spark, sf).select("p_partkey", F.explode(B.outgoing_edges("cell")).alias("edge"))
    return e.select("p_partkey", B.edge_direction("edge").cast("long").alias("direction"), "edge")


@query("h3_edge_origin", f"WITH {PARTS} SELECT p_partkey, d AS direction, {D.edge_origin(D.edge('cell', 'd'))} AS origin FROM cells, range(1, 7) t(d)")
def h3_edge_origin(spark, sf):
    e = h3_outgoing_edges(spark, sf)
    return e.select("p_partkey", "direction", B.edge_origin("edge").alias("origin"))


@query("h3_averages", "SELECT r_regionkey AS res, 2 + 120 * CAST(pow(7, r_regionkey) AS BIGINT) AS cells, 1 + 3 * r_regionkey * (r_regionkey + 1) AS disk FROM region")
def h3_averages(spark, sf):
    r = F.col("r_regionkey")
    return I.table(spark, sf, "region").select(r.alias("res"), B.num_cells(r).alias("cells"), B.max_disk_size(r).cast("int").alias("disk"))


@query("h3_great_circle", f"WITH {I.CUSTOMER_POINTS} SELECT c_custkey, round(2 * 6371.007180918475 * atan2(sqrt(a), sqrt(1 - a)), 5) AS km FROM (SELECT c_custkey, pow(sin(radians(10 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(20 - lon) / 2), 2) AS a FROM points)")
def h3_great_circle(spark, sf):
    return I.customer_points(spark, sf).select("c_custkey", F.round(B.great_circle_km("lon", "lat", F.lit(20.0), F.lit(10.0)), 5).alias("km"))


# ---- frames --------------------------------------------------------------------------------------------------------

_FULL = "(CASE WHEN {p} THEN 6 ELSE 7 END)"


def _compact_sql(keys: str, source: str, top: int) -> str:
    """Levels of compaction as common table expressions; ``source`` has distinct (keys, cell)."""
    out, last = [f"l{top} AS ({source})"], f"l{top}"
    k = f"{keys}, " if keys else ""
    part = f"{keys}, up" if keys else "up"
    for r in range(top, 0, -1):
        out.append(f"g{r} AS (SELECT *, count(*) OVER (PARTITION BY {part}) AS n FROM (SELECT {k}cell, {D.parent('cell', r - 1)} AS up FROM {last} WHERE {D.res('cell')} = {r}))")
        full = _FULL.format(p=D.pentagon("up"))
        out.append(f"l{r - 1} AS (SELECT {k}cell FROM {last} WHERE {D.res('cell')} <> {r} UNION SELECT {k}cell FROM g{r} WHERE n < {full} UNION SELECT {k}up FROM g{r} WHERE n = {full})")
        last = f"l{r - 1}"
    return ", ".join(out)


@query("h3_compact", f"WITH {PARTS}, {_compact_sql('', 'SELECT DISTINCT cell FROM cells', 3)} SELECT cell FROM l0")
def h3_compact(spark, sf):
    return FR.compact(I.part_cells(spark, sf).select("cell"), "cell")


@query("h3_compact_grouped", f"WITH {PARTS}, {_compact_sql('kind', 'SELECT DISTINCT p_size % 2 AS kind, cell FROM cells', 3)} SELECT kind, cell FROM l0")
def h3_compact_grouped(spark, sf):
    return FR.compact(I.part_cells(spark, sf).select((F.col("p_size") % 2).alias("kind"), "cell"), "cell")


@query("h3_uncompact", f"WITH {PARTS}, {_compact_sql('', 'SELECT DISTINCT cell FROM cells', 3)} SELECT DISTINCT cell FROM cells")
def h3_uncompact(spark, sf):
    return FR.uncompact(h3_compact(spark, sf), "cell", 3)


@query("h3_uncompact_subset", f"WITH {PARTS} SELECT DISTINCT child AS cell FROM (SELECT unnest({D.children('cell', 3, 5)}) AS child FROM cells) WHERE child IN (SELECT {D.center_child('cell', 3, 5)} FROM cells WHERE p_size < 10)")
def h3_uncompact_subset(spark, sf):
    c = I.part_cells(spark, sf)
    wanted = c.filter("p_size < 10").select(B.center_child("cell", 5).alias("w"))
    return FR.uncompact_subset(c.select("cell").distinct(), "cell", 5, wanted, "w")


@query("set_predicates", f"WITH {PARTS}, a AS (SELECT DISTINCT cell FROM cells WHERE p_size < 25), b AS (SELECT DISTINCT cell FROM cells) SELECT NOT EXISTS (SELECT * FROM a JOIN b USING (cell)) AS is_disjoint, NOT EXISTS (SELECT * FROM a WHERE cell NOT IN (SELECT cell FROM b)) AS is_subset, NOT EXISTS (SELECT * FROM b WHERE cell NOT IN (SELECT cell FROM a)) AS is_superset")
def set_predicates(spark, sf):
    c = I.part_cells(spark, sf)
    a, b = c.filter("p_size < 25").select("cell").distinct(), c.select("cell").distinct()
    return CO.is_disjoint(a, b, "cell").crossJoin(CO.is_subset(a, b, "cell")).crossJoin(CO.is_superset(a, b, "cell"))  # one row each


@query("set_contains_ancestors", f"WITH {CELLS} SELECT l_orderkey, l_linenumber FROM cells WHERE {D.parent('cell', 2)} IN (SELECT {D.parent('cell', 2)} FROM cells WHERE l_quantity = 50)")
def set_contains_ancestors(spark, sf):
    c = I.lineitem_cells(spark, sf)
    members = c.filter("l_quantity = 50").select(B.parent("cell", 2).alias("cell")).distinct()
    return CO.contains(members, c, "cell").select("l_orderkey", "l_linenumber")


@query("set_pack_unpack", f"WITH {PARTS} SELECT p_size, cell FROM (SELECT DISTINCT p_size, cell FROM cells)")
def set_pack_unpack(spark, sf):
    packed = I.part_cells(spark, sf).groupBy("p_size").agg(CO.pack(F.array_sort(F.collect_set("cell"))).alias("block"))
    return packed.select("p_size", F.explode(CO.unpack("block")).alias("cell"))


@query("resolution_counts", f"WITH {PARTS} SELECT {D.res('cell')} AS h3_res, count(*) AS cells FROM cells GROUP BY 1")
def resolution_counts(spark, sf):
    return CO.counts_by_resolution(I.part_cells(spark, sf), "cell").select(F.col("h3_res").cast("int").alias("h3_res"), "cells")


# ---- graphs --------------------------------------------------------------------------------------------------------

_G = f"{I.LINKS}, g AS (SELECT edge, origin, destination, min(weight) AS weight FROM links GROUP BY ALL)"


def _graph(spark, sf):
    return GR.from_links(I.links(spark, sf), "edge", "origin", "destination", "weight")


@query("graph_min_edges", f"WITH {_G} SELECT edge, origin, destination, weight FROM g")
def graph_min_edges(spark, sf):
    return _graph(spark, sf)


@query("graph_node_types", f"WITH {_G} SELECT cell, CAST(bit_or(t) AS INTEGER) AS node_type FROM (SELECT origin AS cell, 1 AS t FROM g UNION ALL SELECT destination, 2 FROM g) GROUP BY cell")
def graph_node_types(spark, sf):
    return GR.nodes(_graph(spark, sf)).select("cell", F.col("node_type").cast("int").alias("node_type"))


@query("graph_stats", f"WITH {_G} SELECT (SELECT count(DISTINCT c) FROM (SELECT origin AS c FROM g UNION ALL SELECT destination FROM g)) AS num_nodes, (SELECT count(*) FROM g) AS num_edges")
def graph_stats(spark, sf):
    return GR.stats(_graph(spark, sf)).select("num_nodes", "num_edges")


@query("graph_edges_to", f"WITH {_G} SELECT edge, weight FROM g WHERE destination = 7")
def graph_edges_to(spark, sf):
    return GR.edges_to(_graph(spark, sf), 7).select("edge", "weight")


@query("graph_exclude", f"WITH {_G} SELECT edge, weight FROM g WHERE origin % 10 <> 3 AND destination % 10 <> 3")
def graph_exclude(spark, sf):
    gone = spark.range(40).filter("id % 10 = 3")
    return GR.exclude_cells(_graph(spark, sf), gone, "id").select("edge", "weight")


@query("graph_union", f"WITH {_G}, h AS (SELECT edge, origin, destination, weight FROM g UNION ALL SELECT edge, origin, destination, weight - 1 FROM g WHERE origin % 2 = 0) SELECT edge, min(weight) AS weight FROM h GROUP BY edge")
def graph_union(spark, sf):
    g = _graph(spark, sf)
    more = g.filter("origin % 2 = 0").withColumn("weight", F.col("weight") - 1)
    return GR.try_add(g, more).select("edge", "weight")


_REACH = """reach(origin, cell, cost) AS (
  SELECT DISTINCT origin, origin, CAST(0 AS DOUBLE) FROM g WHERE origin IN (0, 5, 10)
  UNION SELECT r.origin, g.destination, r.cost + g.weight FROM reach r JOIN g ON g.origin = r.cell WHERE r.cost + g.weight <= {most})"""


def _rec(most: int) -> str:
    return f"WITH RECURSIVE {_G}, " + _REACH.format(most=most)


def _three(spark):
    return spark.createDataFrame([(0,), (5,), (10,)], "c long")


@query("graph_threshold", f"{_rec(4)} SELECT origin, cell, min(cost) AS cost FROM reach GROUP BY ALL")
def graph_threshold(spark, sf):
    return RO.within_threshold(_graph(spark, sf), _three(spark), "c", 4)


@query("graph_threshold_many", f"{_rec(4)} SELECT cell, min(cost) AS cost FROM reach GROUP BY cell")
def graph_threshold_many(spark, sf):
    return RO.within_threshold_many(_graph(spark, sf), _three(spark), "c", 4)


@query("graph_shortest_path", f"{_rec(12)}, best AS (SELECT origin, cell, min(cost) AS cost FROM reach GROUP BY ALL) SELECT origin, cell AS destination, cost FROM best WHERE cell % 4 = 1")
def graph_shortest_path(spark, sf):
    g = _graph(spark, sf)
    ends = spark.range(40).filter("id % 4 = 1").select("id")
    starts = _three(spark)
    paths = RO._between(g, starts.select(F.col("c").alias("node")), ends.select(F.col("id").alias("node")), None)
    return paths.filter("cost <= 12").select("origin", "destination", "cost")


@query("graph_n_nearest", f"{_rec(12)}, best AS (SELECT origin, cell, min(cost) AS cost FROM reach GROUP BY ALL) SELECT origin, n, cost FROM (SELECT origin, row_number() OVER (PARTITION BY origin ORDER BY cost) AS n, cost FROM best WHERE cell % 4 = 1) WHERE n <= 3")
def graph_n_nearest(spark, sf):
    from pyspark.sql import Window

    ends = spark.range(40).filter("id % 4 = 1").select(F.col("id").alias("node"))
    paths = RO._between(_graph(spark, sf), _three(spark).select(F.col("c").alias("node")), ends, 3)
    return paths.select("origin", F.row_number().over(Window.partitionBy("origin").orderBy("cost")).cast("long").alias("n"), "cost")


@query("graph_relaxed", f"{_rec(4)} SELECT origin, cell, min(cost) AS cost FROM reach GROUP BY ALL")
def graph_relaxed(spark, sf):
    """The plan for graphs that are too large to be sent to all tasks."""
    out = RO._relaxed(_graph(spark, sf), _three(spark).select(F.col("c").alias("origin")), 4.0)
    return out.select("origin", F.col("node").alias("cell"), "cost")


# ---- raster and areas ----------------------------------------------------------------------------------------------

_T = RA.Transform.from_rasterio((0.5, 0.0, -180.0, 0.0, -0.5, 85.0))


@query("affine_apply", f"WITH {I.CUSTOMER_POINTS} SELECT c_custkey, round(lon * 0.5 - 180, 6) AS x, round(lat * -0.5 + 85, 6) AS y FROM points")
def affine_apply(spark, sf):
    x, y = _T.columns("lon", "lat")
    return I.customer_points(spark, sf).select("c_custkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("affine_invert", f"WITH {I.CUSTOMER_POINTS} SELECT c_custkey, round((lon + 180) / 0.5, 6) AS x, round((lat - 85) / -0.5, 6) AS y FROM points")
def affine_invert(spark, sf):
    x, y = _T.invert().columns("lon", "lat")
    return I.customer_points(spark, sf).select("c_custkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("ring_area", f"WITH {I.CUSTOMER_POINTS} SELECT c_custkey, round(abs(radians(1) * (2 + 2 * sin(radians(lat))) - radians(1) * (2 + 2 * sin(radians(lat + 1)))) * 6378137.0 * 6378137.0 / 2 / 1e6, 3) AS km2 FROM points")
def ring_area(spark, sf):
    p = I.customer_points(spark, sf)
    corner = lambda dx, dy: F.struct((F.col("lon") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    ring = F.array(*[corner(*d) for d in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    return p.select("c_custkey", F.round(RA.ring_area(ring) / 1e6, 3).alias("km2"))


@query("within_distance", f"WITH {I.CUSTOMER_POINTS} SELECT c_custkey FROM points WHERE sqrt((lon - 10) * (lon - 10) + (lat - 20) * (lat - 20)) <= 30")
def within_distance(spark, sf):
    return I.customer_points(spark, sf).filter(SP.point_within("lon", "lat", (10.0, 20.0), 30.0)).select("c_custkey")


@query("envelope_intersects", f"WITH {I.CUSTOMER_POINTS} SELECT c_custkey FROM points WHERE lon <= 70 AND lon + 2 >= -40 AND lat <= 50 AND lat + 1 >= -30")
def envelope_intersects(spark, sf):
    e = F.struct(F.col("lon").alias("x0"), F.col("lat").alias("y0"), (F.col("lon") + 2).alias("x1"), (F.col("lat") + 1).alias("y1"))
    return I.customer_points(spark, sf).withColumn("e", e).filter(SP.envelopes_intersect(F.col("e"), (-40.0, -30.0, 70.0, 50.0))).select("c_custkey")


# ---- geometry ------------------------------------------------------------------------------------------------------


def _customer_cells(spark, sf, r: int):
    return I.dealt(I.customer_points(spark, sf), "c_custkey").withColumn("cell", X.from_lonlat("lon", "lat", r))


@query("cell_from_lonlat")
def cell_from_lonlat(spark, sf):
    return _customer_cells(spark, sf, 9).select("c_custkey", "cell", B.is_valid("cell").alias("valid"))


@query("cell_round_trip", "SELECT c_custkey, TRUE AS same FROM customer")
def cell_round_trip(spark, sf):
    """The cell that holds a cell's centre is the cell."""
    c = _customer_cells(spark, sf, 12).withColumn("p", X.to_lonlat("cell"))
    return c.select("c_custkey", (X.from_lonlat("p.x", "p.y", 12) == F.col("cell")).alias("same"))


@query("cell_area_total", "SELECT 510065621.724 AS km2")
def cell_area_total(spark, sf):
    """The areas of all cells of resolution 1 make up the sphere."""
    c = B.res0_cells(spark).select(F.explode(B.children("cell", 1)).alias("cell"))
    return c.agg(F.round(F.sum(X.area_km2("cell")), 3).alias("km2"))


@query("grid_disk_sizes", "SELECT c_custkey, 37 AS cells, 18 AS ring FROM customer")
def grid_disk_sizes(spark, sf):
    """Away from pentagons a disk of 3 steps has 37 cells."""
    return _customer_cells(spark, sf, 13).select("c_custkey", F.size(X.grid_disk("cell", 3)).alias("cells"), F.size(X.grid_ring("cell", 3)).alias("ring"))


def _square(size: float):
    return F.array(F.array(*[F.struct((F.col("lon") + dx * size).alias("x"), (F.col("lat") + dy * size).alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]))


@query("aligned_polygons")
def aligned_polygons(spark, sf):
    c = _customer_cells(spark, sf, 6).select(F.explode(X.grid_disk("cell", 1)).alias("cell")).distinct()
    return FR.dissolve_aligned(c, "cell", 4)


def _cell_graph(spark, sf):
    """Edges out of the cells around all customers."""
    c = I.customer_points(spark, sf).select(X.from_lonlat("lon", "lat", 3).alias("cell")).distinct()
    near = c.select(F.explode(X.grid_disk("cell", 1)).alias("cell")).distinct()
    e = near.select(F.explode(B.outgoing_edges("cell")).alias("edge"))
    return GR.from_edges(e.withColumn("weight", (F.pmod(F.xxhash64("edge"), F.lit(9)) + 1).cast("long")))


@query("graph_covered_area")
def graph_covered_area(spark, sf):
    return GR.covered_area(_cell_graph(spark, sf), 1)


@query("polyfill_estimate", "SELECT c_custkey, TRUE AS enough FROM customer")
def polyfill_estimate(spark, sf):
    """No polygon has more cells than estimated."""
    p = I.dealt(I.customer_points(spark, sf), "c_custkey").withColumn("polygon", _square(0.5))
    return p.select("c_custkey", (F.size(X.polygon_cells("polygon", 5)) <= X.max_polygon_cells("polygon", 5)).alias("enough"))


from hexloom.plans import inner  # noqa: E402, F401  registers its queries
