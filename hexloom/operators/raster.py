"""Rasters as pixel frames (row, col, value) to cells: the pixel at each cell's centre gives the cell its value."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.functions.bits import col
from hexloom.kernel import grid as G
from hexloom.kernel import shapes as S
from hexloom.operators.frame import compact as compact_frame


class TransformNotInvertible(ValueError):
    """An affine transform whose determinant is zero."""


@dataclass(frozen=True)
class Transform:
    """x' = a x + b y + c, y' = d x + e y + f: from array to geographic coordinates."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    @classmethod
    def from_rasterio(cls, v) -> Transform:
        return cls(*map(float, v))

    @classmethod
    def from_gdal(cls, v) -> Transform:
        c, a, b, f, d, e = map(float, v)
        return cls(a, b, c, d, e, f)

    def determinant(self) -> float:
        return self.a * self.e - self.b * self.d

    def is_degenerate(self) -> bool:
        return self.determinant() == 0

    def invert(self) -> Transform:
        det = self.determinant()
        if det == 0:
            raise TransformNotInvertible(str(self))
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Transform(a, b, -self.c * a - self.f * b, d, e, -self.c * d - self.f * e)

    def apply(self, x: float, y: float) -> tuple[float, float]:
        return self.a * x + self.b * y + self.c, self.d * x + self.e * y + self.f

    def columns(self, x: Column | str, y: Column | str) -> tuple[Column, Column]:
        x, y = col(x), col(y)
        return x * self.a + y * self.b + self.c, x * self.d + y * self.e + self.f


def nearest_resolution(shape: tuple[int, int], transform: Transform, axis: str = "yx", mode: str = "min_diff") -> int:
    """The resolution whose cells match a pixel's size.

    ``shape`` is the array's; ``axis`` "yx" says that its second axis is x, "xy" that its first is. ``mode``:
    "min_diff", or "smaller_than_pixel" for the first resolution with cells no larger than a pixel. 15 if none is.
    """
    if len(shape) != 2 or not all(shape):
        raise ValueError("the array has to have two axes and hold something")
    nx, ny = (shape[1], shape[0]) if axis == "yx" else shape
    (x0, y0), (x1, y1) = transform.apply(0, 0), transform.apply(nx - 1, ny - 1)
    pixel = S.ring_area_m2(S.box(min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1))[0]) / (nx * ny)
    centre = np.array([(x0 + x1) / 2]), np.array([(y0 + y1) / 2])
    last = None
    for res in range(16):
        area = S.ring_area_m2(G.boundary(G.from_lonlat(*centre, res))[0])
        if mode == "smaller_than_pixel":
            if area <= pixel:
                return res
        else:
            if last is not None and last < abs(area - pixel):
                return res - 1
            last = abs(area - pixel)
    return 15


def to_cells(pixels: DataFrame, shape: tuple[int, int], transform: Transform, res: int, nodata=None, axis: str = "yx", compact: bool = True, tile: int = 100) -> DataFrame:
    """(value, cell) of a raster; ``pixels`` has row, col, value: positions along the array's first and second axis.

    Tiles that hold data are filled with cells on the executors; each cell looks up its pixel by an equi-join.
    Cells whose pixel is missing or ``nodata`` are left out. NaN is a value like others.
    """
    back = transform.invert()
    x, y = (F.col("col"), F.col("row")) if axis == "yx" else (F.col("row"), F.col("col"))
    data = pixels if nodata is None else pixels.filter(~F.col("value").eqNullSafe(F.lit(nodata)))
    data = data.filter(F.col("value").isNotNull()).withColumn("_x", x.cast("long")).withColumn("_y", y.cast("long"))
    tiles = data.select(F.floor(F.col("_x") / tile).alias("tx"), F.floor(F.col("_y") / tile).alias("ty")).distinct()
    nx, ny = (shape[1], shape[0]) if axis == "yx" else shape

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x0, x1, y0, y1 = a * tile, min((a + 1) * tile, nx), b * tile, min((b + 1) * tile, ny)
                ring = np.array([transform.apply(*p) for p in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])
                cells = S.polygon_cells([ring], res)
                lon, lat = G.to_lonlat(cells)
                px, py = np.floor(lon * back.a + lat * back.b + back.c), np.floor(lon * back.d + lat * back.e + back.f)
                own = (px >= x0) & (px < x1) & (py >= y0) & (py < y1)
                yield pa.RecordBatch.from_arrays([pa.array(cells[own]), pa.array(px[own].astype(np.int64)), pa.array(py[own].astype(np.int64))], names=["cell", "x", "y"])

    # pixels are half open, so a cell is in one tile only, but for centres on a tile's edge
    cells = tiles.repartition("tx", "ty").mapInArrow(fill, "cell bigint, x bigint, y bigint")
    out = cells.join(data.select(F.col("_x").alias("x"), F.col("_y").alias("y"), "value"), ["x", "y"]).select("value", "cell").distinct()
    return compact_frame(out, "cell") if compact else out


def ring_area(points: Column | str) -> Column:
    """Approximate area in m2 of a closed ring (array of struct<x, y>), as an expression."""
    p = col(points)
    ahead = F.slice(p, F.lit(2), F.size(p) - 1)
    parts = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), ahead, lambda a, b: F.radians(b["x"] - a["x"]) * (F.lit(2.0) + F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"]))))
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)) * (S.EARTH_RADIUS_EQUATOR_M**2 / 2)


def data_boxes(grid: np.ndarray, nodata) -> list[tuple[int, int, int, int]]:
    """Boxes (row0, row1, col0, col1), ends included, around the parts of a small array that hold data."""

    def spans(some: np.ndarray) -> list[tuple[int, int]]:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], some, [False]]).astype(np.int8)))
        return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))

    todo, out = [(0, grid.shape[0] - 1, 0, grid.shape[1] - 1)], []
    while todo:
        r0, r1, c0, c1 = todo.pop()
        part = grid[r0 : r1 + 1, c0 : c1 + 1] != nodata
        boxes = [(r0 + a, r0 + b, c0 + c, c0 + d) for a, b in spans(part.any(axis=1)) for c, d in spans(part[a : b + 1].any(axis=0))]
        if boxes == [(r0, r1, c0, c1)]:
            out.append(boxes[0])
        else:
            todo += boxes
    return sorted(out)
