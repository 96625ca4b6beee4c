"""A raster source: TIFF files, with the place that GeoTIFF tags give them, as frames of pixels.

Reads what most tools write plainly: one band of integers or floats, in strips or tiles, uncompressed or deflated, with
or without horizontal differencing. Other files are an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hexloom.operators.raster import Transform

_SIZES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
PIXELS = "path string, row int, col int, value double"


class RasterUnsupported(ValueError):
    """A file that is no TIFF, or of a kind that isn't read here."""


@dataclass
class Tiff:
    """One image: its tags and where its blocks lie."""

    order: str
    tags: dict

    @classmethod
    def parse(cls, raw: bytes) -> Tiff:
        order = {b"II": "<", b"MM": ">"}.get(raw[:2])
        if order is None or struct.unpack_from(order + "H", raw, 2)[0] != 42:
            raise RasterUnsupported("not a TIFF file")
        at = struct.unpack_from(order + "I", raw, 4)[0]
        tags = {}
        for k in range(struct.unpack_from(order + "H", raw, at)[0]):
            tag, kind, n = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
            form = _SIZES.get(kind)
            if form is None:
                continue
            size = struct.calcsize("<" + form) * n
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", raw, at + 10 + 12 * k)[0]
            tags[tag] = raw[place : place + n] if kind == 2 else struct.unpack_from(f"{order}{n * len(form)}{form[0]}", raw, place)
        return cls(order, tags)

    def one(self, tag: int, otherwise=None):
        return self.tags[tag][0] if tag in self.tags else otherwise

    @property
    def shape(self) -> tuple[int, int]:
        return self.one(257), self.one(256)

    @property
    def kind(self) -> np.dtype:
        if self.one(277, 1) != 1:
            raise RasterUnsupported("more than one band")
        return np.dtype(self.order + {1: "u", 2: "i", 3: "f"}[self.one(339, 1)] + str(self.one(258, 1) // 8))

    @property
    def nodata(self) -> float | None:
        return float(self.tags[42113].rstrip(b"\0 ")) if 42113 in self.tags else None

    @property
    def transform(self) -> Transform | None:
        """From (column, row) to coordinates, if the file says so."""
        if 34264 in self.tags:
            m = self.tags[34264]
            return Transform(m[0], m[1], m[3], m[4], m[5], m[7])
        if 33550 not in self.tags or 33922 not in self.tags:
            return None
        (sx, sy, *_), (i, j, _, x, y, *_) = self.tags[33550], self.tags[33922]
        return Transform(sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)

    def blocks(self, raw: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, first column, values) of each strip or tile."""
        rows, cols = self.shape
        tiled = 322 in self.tags
        width, height = (self.one(322), self.one(323)) if tiled else (cols, min(self.one(278, rows), rows))
        where, size = (self.tags[324], self.tags[325]) if tiled else (self.tags[273], self.tags[279])
        across = -(-cols // width)
        for k, (at, n) in enumerate(zip(where, size, strict=True)):
            data = raw[at : at + n]
            if self.one(259, 1) in (8, 32946):
                data = zlib.decompress(data)
            elif self.one(259, 1) != 1:
                raise RasterUnsupported(f"compression {self.one(259)}")
            r, c = k // across * height, k % across * width
            tall = height if tiled else min(height, rows - r)
            block = np.frombuffer(data, self.kind, tall * width).reshape(tall, width)
            if self.one(317, 1) == 2:
                block = np.cumsum(block, axis=1, dtype=block.dtype)
            elif self.one(317, 1) != 1:
                raise RasterUnsupported("predictor")
            yield r, c, block[: rows - r, : cols - c]


def describe(spark: SparkSession, path: str) -> list[tuple[str, tuple[int, int], Transform | None, float | None]]:
    """(path, shape, transform, nodata) of the files, read by the executors; one row a file comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                t = Tiff.parse(content.as_py())
                m = t.transform
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([t.shape[0]], pa.int32()), pa.array([t.shape[1]], pa.int32()), pa.array([None if m is None else [m.a, m.b, m.c, m.d, m.e, m.f]], pa.list_(pa.float64())), pa.array([t.nodata], pa.float64())], names=["path", "rows", "cols", "transform", "nodata"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, rows int, cols int, transform array<double>, nodata double")
    return [(r["path"], (r["rows"], r["cols"]), None if r["transform"] is None else Transform(*r["transform"]), r["nodata"]) for r in found.collect()]


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, value) of all pixels of the files; a file is one task's work, read block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_py()
                for r, c, block in Tiff.parse(raw).blocks(raw):
                    row, col = np.indices(block.shape, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * block.size), pa.array((row + r).ravel().astype(np.int32)), pa.array((col + c).ravel().astype(np.int32)), pa.array(block.ravel().astype(np.float64))], names=["path", "row", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, PIXELS)
