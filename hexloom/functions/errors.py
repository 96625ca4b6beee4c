"""The published error codes as exceptions, and strict forms of functions that otherwise give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.functions import bits as B
from hexloom.functions.bits import col

# fixed values: the published error codes by number
CODES = (
    "Success", "Failed", "Domain", "LatLonDomain", "ResDomain", "CellInvalid", "DirectedEdgeInvalid", "UndirectedEdgeInvalid",
    "VertexInvalid", "Pentagon", "DuplicateInput", "NotNeighbors", "ResMismatch", "MemoryAlloc", "MemoryBounds", "OptionInvalid",
)


class GridError(ValueError):
    """An error of the published set, by its code."""

    def __init__(self, code: int, detail: str = ""):
        self.code, self.name = code, CODES[code]
        super().__init__(f"{self.name}: {detail}" if detail else self.name)


def error_of(code: int) -> GridError | None:
    """The error of a code; None for success, ``Failed`` for numbers that aren't published."""
    return None if code == 0 else GridError(code if 0 < code < len(CODES) else 1, "" if 0 < code < len(CODES) else f"code {code}")


def check_resolution(r: int) -> int:
    if not 0 <= r <= 15:
        raise GridError(4, f"{r} is not between 0 and 15")
    return r


def check_same_resolution(df: DataFrame, *cells: str) -> int | None:
    """The one resolution of all valid ids in the columns, None if there are none; an error if there are more."""
    found = {r["r"] for c in cells for r in df.select(B.resolution(c).alias("r")).filter("r IS NOT NULL").distinct().collect()}  # 16 at most
    if len(found) > 1:
        raise GridError(12, str(sorted(found)))
    return next(iter(found), None)


def same_resolution(a: Column | str, b: Column | str) -> Column:
    """``a`` where both ids have one resolution; an error in the query where they don't."""
    wrong = F.raise_error(F.concat(F.lit("ResMismatch: "), col(a).cast("string"), F.lit(", "), col(b).cast("string"))).cast("long")
    return F.when(B.raw_resolution(a) == B.raw_resolution(b), col(a)).when(col(a).isNotNull() & col(b).isNotNull(), wrong)


def required(value: Column, kind: str = "Failed", *about: Column | str) -> Column:
    """``value``, or an error in the query where it is null: ``required(geo.grid_path("a", "b"), "Failed", "a", "b")``,
    ``required(geo.directed_edge("a", "b"), "NotNeighbors", "a", "b")``."""
    if kind not in CODES:
        raise ValueError(kind)
    text = F.concat_ws(" ", F.lit(kind + ":"), *[col(c).cast("string") for c in about])
    return F.coalesce(value, F.raise_error(text))
