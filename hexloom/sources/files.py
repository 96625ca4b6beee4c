"""Graph and cell sinks and sources: Parquet, GeoJSON lines, well-known binary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.functions import bits as B
from hexloom.functions import geo as X
from hexloom.kernel.geometry import from_wkb, to_wkb


def save_graph(graph: DataFrame, path: str, compression: str = "zstd") -> None:
    """Write a graph, sorted by origin within files so that ids compress and lookups prune."""
    graph.repartitionByRange("origin").sortWithinPartitions("origin", "edge").write.mode("overwrite").option("compression", compression).parquet(path)


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_cells(df: DataFrame, cell: str, path: str, coarse: int = 2) -> None:
    """Write cells by resolution and ancestor, so that scans of a region skip the other folders."""
    out = df.withColumn("h3_res", B.resolution(cell)).withColumn("h3_parent", B.to_hex(B.raw_parent(cell, F.least(F.lit(coarse), B.raw_resolution(cell)))))
    out.repartition("h3_res", "h3_parent").sortWithinPartitions(cell).write.mode("overwrite").partitionBy("h3_res", "h3_parent").parquet(path)


def _positions(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.array(p["x"], p["y"]))


def geojson(df: DataFrame, cell: str) -> DataFrame:
    """One GeoJSON feature a row: the cell's polygon, with id and resolution."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(_positions(X.boundary(cell))).alias("coordinates"))
    properties = F.struct(B.to_hex(cell).alias("h3index"), B.resolution(cell).alias("h3res"))
    return df.filter(B.is_valid(cell)).select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("value"))


def save_geojson(df: DataFrame, cell: str, path: str) -> None:
    """GeoJSON, a feature a line."""
    geojson(df, cell).write.mode("overwrite").text(path)


def polygon_to_wkb(polygon: list) -> bytes:
    """Well-known binary of a polygon (rings of (x, y))."""
    return to_wkb(("Polygon", polygon))


def polygon_from_wkb(raw: bytes) -> list:
    kind, rings = from_wkb(raw)
    if kind != "Polygon":
        raise ValueError("not a polygon")
    return [[tuple(p) for p in r] for r in rings]
