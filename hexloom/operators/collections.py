"""Sets of cells as frames, and packed blocks of ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.functions import bits as B
from hexloom.functions.bits import col


def union(a: DataFrame, b: DataFrame, cell: str) -> DataFrame:
    return a.select(cell).unionByName(b.select(cell)).distinct()


def is_disjoint(a: DataFrame, b: DataFrame, cell: str) -> DataFrame:
    """One row: whether no cell is in both."""
    return a.select(cell).join(b.select(cell), cell, "left_semi").agg((F.count("*") == 0).alias("is_disjoint"))


def is_subset(a: DataFrame, b: DataFrame, cell: str) -> DataFrame:
    """One row: whether all cells of ``a`` are in ``b``."""
    return a.select(cell).join(b.select(cell), cell, "left_anti").agg((F.count("*") == 0).alias("is_subset"))


def is_superset(a: DataFrame, b: DataFrame, cell: str) -> DataFrame:
    return is_subset(b, a, cell).withColumnRenamed("is_subset", "is_superset")


def contains(members: DataFrame, asked: DataFrame, cell: str) -> DataFrame:
    """Rows of ``asked`` of which the cell or an ancestor is in ``members``: one semi-join if these have one resolution,
    else one on the ancestors at each of theirs."""
    found = members.select(B.resolution(cell).alias("r")).filter("r IS NOT NULL").distinct().collect()  # 16 rows at most
    levels = sorted(x["r"] for x in found)
    own = members.select(F.col(cell).alias("_a"))
    if len(levels) < 2:
        up = B.parent(cell, levels[0]) if levels else F.lit(None).cast("long")
        return asked.join(own, up == F.col("_a"), "left_semi")
    up = asked.select(F.col(cell).alias("_c"), F.explode(F.array_compact(F.array(*[B.parent(cell, r) for r in levels]))).alias("_a"))
    return asked.join(up.join(own, "_a", "left_semi").select("_c").distinct(), asked[cell] == F.col("_c"), "left_semi")


def counts_by_resolution(df: DataFrame, cell: str) -> DataFrame:
    return df.groupBy(B.resolution(cell).alias("h3_res")).agg(F.count("*").alias("cells"))


def finest_resolution(df: DataFrame, cell: str) -> DataFrame:
    return df.agg(F.max(B.resolution(cell)).alias("finest"))


# ---- blocks: byte planes of the ids, run-length coded --------------------------------------------------------------


class DecompressionError(ValueError):
    """A block whose bytes don't decode."""


def rle_encode(raw: np.ndarray) -> bytes:
    """Pairs of byte and count, counts up to 255."""
    if not len(raw):
        return b""
    start = np.flatnonzero(np.concatenate([[True], raw[1:] != raw[:-1]]))
    length = np.diff(np.append(start, len(raw)))
    parts = -(-length // 255)
    value = np.repeat(raw[start], parts)
    count = np.full(len(value), 255, np.uint8)
    last = np.cumsum(parts) - 1
    count[last] = length - (parts - 1) * 255
    return np.stack([value, count], axis=1).astype(np.uint8).tobytes()


def rle_decode(raw: bytes) -> np.ndarray:
    if len(raw) % 2:
        raise DecompressionError("odd number of bytes")
    pairs = np.frombuffer(raw, np.uint8).reshape(-1, 2)
    return np.repeat(pairs[:, 0], pairs[:, 1])


def pack_block(ids: np.ndarray) -> bytes:
    return rle_encode(np.ascontiguousarray(ids.astype(">i8").view(np.uint8).reshape(-1, 8).T).ravel())


def unpack_block(raw: bytes) -> np.ndarray:
    planes = rle_decode(raw)
    if len(planes) % 8:
        raise DecompressionError("not a whole number of ids")
    return np.ascontiguousarray(planes.reshape(8, -1).T).ravel().view(">i8").astype(np.int64)


def pack(ids: Column | str) -> Column:
    """An array of ids as one binary block; nulls in it are skipped."""

    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else pack_block(np.array([v for v in x if v is not None], np.int64)) for x in a.to_pylist()], pa.binary())

    def one(a: pa.Array) -> pa.Array:
        return run(a)

    return F.arrow_udf(one, "binary")(col(ids))


def unpack(block: Column | str) -> Column:
    """The ids of a block, in order."""

    def one(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else unpack_block(x) for x in a.to_pylist()], pa.list_(pa.int64()))

    return F.arrow_udf(one, "array<bigint>")(col(block))


def block_contains(block: Column | str, c: Column | str) -> Column:
    return F.array_contains(unpack(block), col(c))


def block_sizes(block: Column | str) -> Column:
    """struct<packed, plain>: bytes of a block, and of its ids as they are."""
    return F.struct(F.octet_length(col(block)).alias("packed"), (F.size(unpack(block)) * 8).alias("plain"))
