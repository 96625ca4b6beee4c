"""Operators on frames with a cell column: validity, resolution, compaction, clusters, neighbour values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.functions import bits as B
from hexloom.functions import geo as X
from hexloom.operators.components import components
from hexloom.sources.shared import written


class InvalidCells(ValueError):
    """A column that holds ids which aren't valid."""


def filter_valid(df: DataFrame, cell: str) -> DataFrame:
    """Rows whose id is a cell; null and invalid ids go."""
    return df.filter(B.is_valid(cell))


def all_valid(df: DataFrame, cell: str) -> DataFrame:
    """One row: whether all ids are valid. Null counts as invalid; an empty frame is valid."""
    return df.agg(F.coalesce(F.bool_and(F.coalesce(B.is_valid(cell), F.lit(False))), F.lit(True)).alias("all_valid"))


def with_resolution(df: DataFrame, cell: str, name: str = "h3_res") -> DataFrame:
    return df.withColumn(name, B.resolution(cell))


def partition_by_resolution(df: DataFrame, cell: str) -> dict[int, DataFrame]:
    """A frame for each resolution that occurs; null and invalid ids are in none."""
    found = df.select(B.resolution(cell).alias("r")).filter("r IS NOT NULL").distinct().collect()  # 16 rows at most
    return {r["r"]: df.filter(B.resolution(cell) == r["r"]) for r in sorted(found)}


def change_resolution(df: DataFrame, cell: str, r: int, keep_source: str | None = None) -> DataFrame:
    """Each row once for each cell of the changed resolution: descendants, the cell itself or its ancestor."""
    own = B.raw_resolution(cell)
    count = F.when(own < r, B.child_count(cell, r)).otherwise(F.lit(1).cast("long"))
    out = df.filter(B.is_valid(cell)).withColumn("_n", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    new = F.when(own < r, B.child_at(cell, r, F.col("_n"))).otherwise(B.raw_parent(cell, r))
    if keep_source:
        out = out.withColumn(keep_source, F.col(cell))
    return out.withColumn(cell, new).drop("_n").filter(B.is_valid(cell))


def uncompact(df: DataFrame, cell: str, r: int) -> DataFrame:
    """Coarser cells expanded to ``r``, cells at ``r`` kept, finer and invalid ones dropped; the cell comes last."""
    out = change_resolution(df.filter(B.raw_resolution(cell) <= r), cell, r)
    return out.select(*[c for c in df.columns if c != cell], cell)


def uncompact_subset(df: DataFrame, cell: str, r: int, subset: DataFrame, subset_cell: str) -> DataFrame:
    """``uncompact``, but only cells in ``subset`` (changed to ``r`` first).

    Rows without any member of the subset below them go before they are expanded.
    """
    wanted = change_resolution(subset.select(F.col(subset_cell).alias("_w")), "_w", r).distinct()
    some = df.filter(B.is_valid(cell) & (B.raw_resolution(cell) <= r))
    levels = [x["r"] for x in some.select(B.raw_resolution(cell).alias("r")).distinct().collect()]
    parts = None
    for level in levels:
        above = wanted.select(B.raw_parent("_w", level).alias("_up")).distinct()
        own = some.filter(B.raw_resolution(cell) == level)
        own = own.join(above, own[cell] == above["_up"], "left_semi")
        parts = own if parts is None else parts.unionByName(own)
    out = uncompact(parts if parts is not None else some, cell, r)
    return out.join(wanted, out[cell] == wanted["_w"], "left_semi")


def purge_covered(df: DataFrame, cell: str, keys: list[str]) -> DataFrame:
    """Without cells of which an ancestor is in the same group."""
    levels = sorted(x["r"] for x in df.select(B.raw_resolution(cell).alias("r")).distinct().collect())
    if len(levels) < 2:
        return df
    up = F.array(*[F.when(B.raw_resolution(cell) > r, B.raw_parent(cell, r)) for r in levels[:-1]])
    coarse = df.select(*[F.col(k).alias("_k" + str(i)) for i, k in enumerate(keys)], F.col(cell).alias("_up"))
    asked = df.select(*keys, cell, F.explode(F.array_compact(up)).alias("_a"))
    same = [asked[k].eqNullSafe(F.col("_k" + str(i))) for i, k in enumerate(keys)]
    covered = asked.join(coarse, [asked["_a"] == coarse["_up"], *same], "left_semi").select(*keys, F.col(cell).alias("_c")).distinct()
    covered = covered.select(*[F.col(k).alias("_k" + str(i)) for i, k in enumerate(keys)], "_c")
    same = [df[k].eqNullSafe(covered["_k" + str(i)]) for i, k in enumerate(keys)]
    return df.join(covered, [df[cell] == covered["_c"], *same], "left_anti")


def compact(df: DataFrame, cell: str, exploded: bool = True) -> DataFrame:
    """Complete sets of siblings become their parents, by group of all other columns; the cell comes last.

    One aggregate shuffles each level between the finest and the coarsest resolution that can change; a group there
    is at most seven cells.
    """
    keys = [c for c in df.columns if c != cell]
    left = df.filter(B.is_valid(cell)).select(*keys, cell).distinct()
    top = left.agg(F.max(B.raw_resolution(cell))).first()[0] or 0
    for r in range(top, 0, -1):
        fine = B.raw_resolution(cell) == r
        up = F.when(fine, B.raw_parent(cell, r - 1)).otherwise(F.col(cell))
        sets = left.groupBy(*keys, up.alias("_up"), fine.alias("_fine")).agg(F.collect_set(cell).alias("_set"))
        full = F.col("_fine") & (F.size("_set") == F.when(B.is_pentagon("_up"), 6).otherwise(7))
        left = sets.select(*keys, F.explode(F.when(full, F.array("_up")).otherwise(F.col("_set"))).alias(cell))
    out = purge_covered(written(left.distinct(), "compacted"), cell, keys)
    return out.select(*keys, cell) if exploded else out.groupBy(*keys).agg(F.array_sort(F.collect_set(cell)).alias(cell))


def adjacency(df: DataFrame, cell: str, value: str | None = None) -> DataFrame:
    """Pairs (a, b) of neighbouring cells of the frame, those with equal ``value`` only."""
    v = [F.col(value).alias("_v")] if value else []
    own = df.filter(B.is_valid(cell)).select(F.col(cell).alias("a"), *v).distinct()
    near = own.select("a", *(["_v"] if value else []), F.explode(X.grid_ring("a", 1)).alias("b"))
    other = own.select(F.col("a").alias("_b"), *([F.col("_v").alias("_w")] if value else []))
    same = [near["b"] == other["_b"]] + ([near["_v"].eqNullSafe(other["_w"])] if value else [])
    return near.join(other, same, "left_semi").select("a", "b")


def clusters(df: DataFrame, cell: str, value: str | None = None) -> DataFrame:
    """(cluster_num, [value,] cells): components of neighbouring cells, with equal values if one is named.

    Clusters are numbered by their smallest cell. With values a cell must have one value; cells that repeat count once.
    """
    rows = flat_clusters(df, cell, value)
    keys = ["component"] + ([value] if value else [])
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(cell)).alias("cells"))
    # numbering needs one order over all clusters: rank within ranges, then add the ranges' offsets
    ranked = out.repartitionByRange("component").withColumn("_p", F.spark_partition_id())
    sizes = {r["_p"]: r["n"] for r in ranked.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    total, offsets = 0, {}
    for p in sorted(sizes):
        offsets[p], total = total, total + sizes[p]
    from pyspark.sql import Window

    start = F.element_at(F.create_map(*[F.lit(x) for kv in (offsets or {0: 0}).items() for x in kv]), F.col("_p"))
    number = (start + F.row_number().over(Window.partitionBy("_p").orderBy("component")) - 1).cast("int")
    return ranked.withColumn("cluster_num", number).select("cluster_num", *([value] if value else []), "cells")


def flat_clusters(df: DataFrame, cell: str, value: str | None = None) -> DataFrame:
    """Each distinct cell with its cluster's smallest cell as ``component``."""
    keep = [cell] + ([value] if value else [])
    own = df.filter(B.is_valid(cell)).select(*keep).distinct()
    label = components(adjacency(df, cell, value), "a", "b")
    return own.join(label, own[cell] == label["id"], "left").select(*keep, F.coalesce("component", cell).alias("component"))


def neighbor_values(cells: DataFrame, values: DataFrame, cell: str, value: str, k_min: int, k_max: int, default=None) -> DataFrame:
    """(cell, cell_value, neighbor_cell, neighbor_value, k) for cells that have a value and their neighbours from
    ``k_min`` to ``k_max`` steps away; neighbours without a value take ``default``, or are left out if that is None."""
    known = values.select(F.col(cell).alias("cell"), F.col(value).alias("cell_value")).filter("cell_value IS NOT NULL")
    origin = cells.select(F.col(cell).alias("cell")).join(known, "cell")
    near = origin.select("cell", "cell_value", F.inline(X.grid_disk_distances("cell", k_min, k_max)).alias("k", "neighbor_cell"))
    other = known.select(F.col("cell").alias("neighbor_cell"), F.col("cell_value").alias("neighbor_value"))
    out = near.join(other, "neighbor_cell", "inner" if default is None else "left")
    value_of = F.col("neighbor_value") if default is None else F.coalesce("neighbor_value", F.lit(default))
    return out.select("cell", "cell_value", "neighbor_cell", value_of.alias("neighbor_value"), "k")


def cells_to_edges(df: DataFrame, cell: str, order: str, keys: list[str]) -> DataFrame:
    """Edges between consecutive cells of each sequence; repeated cells count once, cells that aren't neighbours give a
    null edge."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    steps = df.withColumn("_from", F.lag(cell).over(w)).filter(F.col("_from").isNotNull() & (F.col("_from") != F.col(cell)))
    return steps.select(*keys, order, X.directed_edge("_from", cell).alias("edge"))


def following_edges(e: Column | str) -> Column:
    """Edges out of an edge's destination, without the one that leads back."""
    out = B.outgoing_edges(X.edge_destination(e))
    return F.array_except(out, F.array(X.edge_reversed(e)))


def previous_edges(df: DataFrame, edge: str) -> DataFrame:
    """(edge, previous) for each edge into an edge's origin, without the one that leads back."""
    back = df.select(edge, F.explode(B.outgoing_edges(B.edge_origin(edge))).alias("_out"))
    back = back.filter(F.col("_out") != F.col(edge))
    return back.select(edge, X.edge_reversed("_out").alias("previous"))


def bounding_rect(df: DataFrame, cell: str, kind: str = "cell") -> DataFrame:
    """One row x0, y0, x1, y1 around all cells (or edges); null and invalid ids are skipped."""
    e = df.select(X.envelope(cell, kind).alias("e"))
    return e.agg(F.min("e.x0").alias("x0"), F.min("e.y0").alias("y0"), F.max("e.x1").alias("x1"), F.max("e.y1").alias("y1"))


TASK_CELLS = 200_000


def polygon_cells(df: DataFrame, polygon: str, res: int, cell: str = "cell", touching: bool = False) -> DataFrame:
    """``df`` once for each cell of its polygon. Rows are dealt out first if an estimate from their envelopes says that
    they have more cells than a few tasks should fill."""
    least = df.agg(F.sum(X.max_polygon_cells(polygon, res))).first()[0] or 0
    tasks = min(df.sparkSession.sparkContext.defaultParallelism * 8, -(-least // TASK_CELLS))
    dealt = df.repartition(int(tasks)) if tasks > 1 else df
    cells = X.polygon_cells_touching(polygon, res) if touching else X.polygon_cells(polygon, res)
    return dealt.withColumn(cell, F.explode(cells))


def dissolve(df: DataFrame, cell: str, keys: list[str], smoothen: bool = False) -> DataFrame:
    """Polygons of each group's cells, which must share a resolution."""
    return df.filter(B.is_valid(cell)).groupBy(*keys).agg(F.collect_set(cell).alias("_c")).select(*keys, X.dissolve("_c", smoothen).alias("polygons"))


def dissolve_aligned(df: DataFrame, cell: str, r: int, smoothen: bool = True) -> DataFrame:
    """Polygons by ancestor at ``r``; a group is one ancestor's descendants, so groups stay bounded."""
    return dissolve_groups(df.filter(B.is_valid(cell)).withColumn("parent", B.parent(cell, r)), cell, r, smoothen)


def dissolve_groups(df: DataFrame, cell: str, r: int, smoothen: bool) -> DataFrame:
    return df.groupBy("parent").agg(F.collect_set(cell).alias("_c")).select("parent", X.dissolve_aligned("_c", r, smoothen).alias("polygons"))


def edges_to_lines(df: DataFrame, edge: str, order: str, keys: list[str]) -> DataFrame:
    """Lines through the centres of consecutive edges; a new one wherever an edge doesn't begin where the last ended."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    e = df.withColumn("_o", B.edge_origin(edge)).withColumn("_d", X.edge_destination(edge))
    e = e.withColumn("_new", F.when(F.lag("_d").over(w) == F.col("_o"), 0).otherwise(1)).withColumn("line", F.sum("_new").over(w))
    out = e.groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("p"), "_o", "_d"))).alias("s"))
    cells = F.concat(F.array(F.col("s")[0]["_o"]), F.transform("s", lambda x: x["_d"]))
    points = out.select(*keys, "line", F.posexplode(cells).alias("p", "c")).withColumn("xy", X.to_lonlat("c"))
    return points.groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.struct("p", "xy"))).alias("s")).select(*keys, "line", F.transform("s", lambda x: x["xy"]).alias("points"))


class CellFrame:
    """A frame that remembers its cell column."""

    def __init__(self, df: DataFrame, cell: str, validate: bool = True):
        self.df, self.cell = df, cell
        if dict(df.dtypes).get(cell) != "bigint":
            raise ValueError(f"column {cell} is not a bigint")
        if validate:
            self.validate()

    def validate(self) -> CellFrame:
        if not all_valid(self.df, self.cell).first()[0]:
            raise InvalidCells(self.cell)
        return self

    def _with(self, df: DataFrame) -> CellFrame:
        return CellFrame(df, self.cell, validate=False)

    @property
    def column(self) -> Column:
        return self.df[self.cell]

    def resolution(self, name: str = "h3_res") -> CellFrame:
        return self._with(with_resolution(self.df, self.cell, name))

    def filter_valid(self) -> CellFrame:
        return self._with(filter_valid(self.df, self.cell))

    def change_resolution(self, r: int) -> CellFrame:
        return self._with(change_resolution(self.df, self.cell, r))

    def compact(self, exploded: bool = True) -> DataFrame:
        return compact(self.df, self.cell, exploded)

    def uncompact(self, r: int) -> CellFrame:
        return self._with(uncompact(self.df, self.cell, r))

    def uncompact_subset(self, r: int, subset: DataFrame, subset_cell: str) -> CellFrame:
        return self._with(uncompact_subset(self.df, self.cell, r, subset, subset_cell))

    def partition_by_resolution(self) -> dict[int, DataFrame]:
        return partition_by_resolution(self.df, self.cell)

    def clusters(self, value: str | None = None) -> DataFrame:
        return clusters(self.df, self.cell, value)

    def bounding_rect(self) -> DataFrame:
        return bounding_rect(self.df, self.cell)
