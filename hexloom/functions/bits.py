"""Cell and edge functions that are plain integer arithmetic, as Column expressions.

They need no Python worker: Catalyst folds them, pushes filters through them and compiles them with the stage around
them. Results for ids that aren't valid, and for null, are null unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the published grid: base cells that are pentagons
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)
DIGIT_MASK = (1 << 45) - 1
ONES = sum(8**i for i in range(15))
DIRECTIONS = ("center", "k", "j", "jk", "i", "ik", "ij")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _long(x: int | Column) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x.cast("long")


def shl(a: int | Column, n: int | Column) -> Column:
    return F.call_function("shiftleft", _long(a), F.lit(n) if isinstance(n, int) else n.cast("int"))


def shr(a: Column, n: int | Column) -> Column:
    return F.call_function("shiftright", a, F.lit(n) if isinstance(n, int) else n.cast("int"))


def raw_resolution(c: Column | str) -> Column:
    """The resolution bits, whether the id is valid or not."""
    return shr(col(c), 52).bitwiseAND(F.lit(15)).cast("int")


def base_cell(c: Column | str) -> Column:
    return shr(col(c), 45).bitwiseAND(F.lit(127)).cast("int")


def digit(c: Column | str, r: int | Column) -> Column:
    """The digit at resolution ``r``."""
    n = (15 - r) * 3
    return shr(col(c), n).bitwiseAND(F.lit(7)).cast("int")


def _used(c: Column) -> Column:
    return shr(c.bitwiseAND(_long(DIGIT_MASK)), (F.lit(15) - raw_resolution(c)) * 3)


def _lead_is_k(y: Column) -> Column:
    """Whether the first digit that isn't zero is 1: then the highest bit's position is a multiple of 3."""
    return (y > 0) & ((F.length(F.bin(y)) - 1) % 3 == 0)


def is_valid(c: Column | str) -> Column:
    """Whether an id is a cell; null for null."""
    c = col(c)
    sevens = c.bitwiseAND(shr(c, 1)).bitwiseAND(shr(c, 2)).bitwiseAND(_long(ONES))  # a bit for each digit that is 7
    unused = F.get(F.array(*[_long(((1 << (15 - r) * 3) - 1) & ONES) for r in range(16)]), raw_resolution(c))
    good = (shr(c, 56) == 8) & (base_cell(c) < 122) & (sevens == unused)
    return good & ~(base_cell(c).isin(*PENTAGONS) & _lead_is_k(_used(c)))


def try_cell(c: Column | str, strict: bool = False) -> Column:
    """The id where it is a cell; null, or with ``strict`` an error, where it isn't."""
    c = col(c)
    wrong = F.raise_error(F.concat(F.lit("CellInvalid: "), c.cast("string"))).cast("long") if strict else F.lit(None).cast("long")
    return F.when(c.isNull(), F.lit(None).cast("long")).when(is_valid(c), c).otherwise(wrong)


def resolution(c: Column | str) -> Column:
    return F.when(is_valid(c), raw_resolution(c)).cast("tinyint")


def is_pentagon(c: Column | str) -> Column:
    c = col(c)
    return base_cell(c).isin(*PENTAGONS) & (_used(c) == 0)


def is_class_iii(c: Column | str) -> Column:
    return raw_resolution(c) % 2 == 1


def _at_resolution(c: Column, r: int | Column) -> Column:
    r = _long(r)
    return c.bitwiseAND(_long(~(15 << 52))).bitwiseOR(F.call_function("shiftleft", r, F.lit(52)))


def raw_parent(c: Column | str, r: int | Column) -> Column:
    """The ancestor at ``r``, for cells known to be as fine."""
    n = (15 - r) * 3
    return _at_resolution(col(c), r).bitwiseOR(shl(1, n) - 1)


def parent(c: Column | str, r: int | Column) -> Column:
    """The ancestor at ``r``; null where ``r`` is finer than the cell."""
    return F.when(is_valid(c) & (raw_resolution(c) >= F.lit(r) if isinstance(r, int) else raw_resolution(c) >= r), raw_parent(c, r))


def center_child(c: Column | str, r: int) -> Column:
    """The descendant at ``r`` in the middle; null where ``r`` is coarser."""
    c = col(c)
    own = raw_resolution(c)
    clear = (shl(1, (F.lit(15) - own) * 3) - 1) - (shl(1, (15 - r) * 3) - 1)
    return F.when(is_valid(c) & (own <= r), _at_resolution(c, r).bitwiseAND(F.bitwise_not(clear)))


def child_at(c: Column | str, r: int, n: Column) -> Column:
    """The descendant at ``r`` whose digits below the cell's own spell ``n`` in base 7."""
    c = col(c)
    own = raw_resolution(c)
    clear = (shl(1, (F.lit(15) - own) * 3) - 1) - (shl(1, (15 - r) * 3) - 1)
    head = _at_resolution(c, r).bitwiseAND(F.bitwise_not(clear))
    return head.bitwiseOR(F.call_function("shiftleft", base7(n), F.lit((15 - r) * 3)))


def base7(n: Column) -> Column:
    """The base 7 digits of a number in three bits each: one use of ``n``, however many digits it has."""
    return F.conv(F.conv(n.cast("string"), 10, 7), 8, 10).cast("long")


def child_count(c: Column | str, r: int) -> Column:
    """Number of base 7 numbers that ``child_at`` takes for a cell, those of a pentagon's missing children included;
    null where ``r`` is coarser."""
    own = raw_resolution(c)
    sizes = F.array(*[_long(7**k) for k in range(16)])
    return F.when(is_valid(c) & (own <= r), F.get(sizes, F.lit(r) - own))


def children(c: Column | str, r: int) -> Column:
    """All descendants at ``r`` as an array; the cell itself at its own resolution, null where ``r`` is coarser."""
    c = col(c)
    found = F.transform(F.sequence(_long(0), child_count(c, r) - 1), lambda n: child_at(c, r, n))
    return F.when(is_valid(c) & (raw_resolution(c) <= r), F.filter(found, is_valid))


def children_size(c: Column | str, r: int) -> Column:
    """Number of descendants at ``r``."""
    c = col(c)
    d = F.lit(r) - raw_resolution(c)
    hexagon = F.get(F.array(*[_long(7**k) for k in range(16)]), d)
    pentagon = F.get(F.array(*[_long(1 + 5 * (7**k - 1) // 6) for k in range(16)]), d)
    return F.when(is_valid(c) & (d >= 0), F.when(is_pentagon(c), pentagon).otherwise(hexagon))


def child_pos(c: Column | str, r: int) -> Column:
    """The position of a cell among the descendants of its ancestor at ``r``, in order of their ids."""
    c = col(c)
    own = raw_resolution(c)
    y = _used(c).bitwiseAND(shl(1, (own - r) * 3) - 1)
    place = F.conv(F.conv(y.cast("string"), 10, 8), 7, 10).cast("long")  # the digits, read in base 7
    # below a pentagon the first digit d > 1 stands after a pentagon's children, and the missing child's
    t = ((F.length(F.bin(y)) - 1) / 3).cast("int")
    sizes = F.array(*[_long(2 * 7**k - (1 + 5 * (7**k - 1) // 6)) for k in range(16)])
    lost = F.when((y > 0) & is_pentagon(raw_parent(c, r)), F.get(sizes, t)).otherwise(_long(0))
    return F.when(is_valid(c) & (own >= r), place - lost)


def child_from_pos(c: Column | str, r: int, pos: Column | str) -> Column:
    """The descendant at ``r`` at a position among all; null where there is none."""
    return F.get(children(c, r), col(pos).cast("int"))


def change_resolution(c: Column | str, r: int) -> Column:
    """Descendants, the cell itself or its ancestor, as an array."""
    c = col(c)
    return F.when(raw_resolution(c) < r, children(c, r)).otherwise(F.when(is_valid(c), F.array(raw_parent(c, r))))


def is_parent_of(a: Column | str, b: Column | str) -> Column:
    """Whether ``a`` is ``b`` or an ancestor of it; null where ``a`` is finer."""
    return parent(b, raw_resolution(a)) == col(a)


def is_child_of(a: Column | str, b: Column | str) -> Column:
    return is_parent_of(b, a)


contains = is_parent_of


def descendant_range(cell: int, r: int) -> tuple[int, int]:
    """The least and greatest id that a descendant of ``cell`` at ``r`` can have: a filter that reaches the scan."""
    head = (cell & ~(15 << 52)) | (r << 52)
    own = (cell >> 52) & 15
    low = head & ~(((1 << ((15 - own) * 3)) - 1) - ((1 << ((15 - r) * 3)) - 1))
    return low, head


# ---- text --------------------------------------------------------------------------------------------------------


def to_hex(c: Column | str) -> Column:
    return F.lower(F.hex(col(c)))


def from_hex(s: Column | str, kind: str = "cell") -> Column:
    """A cell (or edge) from hex digits; null where they are none."""
    s = F.regexp_replace(col(s), "^0[xX]", "")
    good = F.length(s).between(1, 16) & s.rlike("^[0-9a-fA-F]+$")
    id_ = F.when(good, F.conv(s, 16, 10).cast("decimal(20,0)"))
    id_ = F.when(id_ <= F.lit(9223372036854775807).cast("decimal(20,0)"), id_.cast("long"))
    return bound(id_, lambda x: F.when(is_valid(x) if kind == "cell" else is_valid_edge(x), x))


def bound(c: Column, f) -> Column:
    """``f`` of a costly expression, which is evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


_TRIPLE = r"^\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)\s*[,;]\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)\s*[,;]\s*([0-9]{1,2})"


def parse_triple(s: Column | str) -> Column:
    """struct<x, y, res> of text like ``23.3,12.3,6``; text after it is ignored; null where it doesn't fit."""
    s = col(s)
    got = [F.regexp_extract(s, _TRIPLE, k) for k in (1, 2, 3)]
    return F.when(s.rlike(_TRIPLE), F.struct(got[0].try_cast("double").alias("x"), got[1].try_cast("double").alias("y"), got[2].try_cast("int").alias("res")))


def from_string(s: Column | str) -> Column:
    """A cell from hex digits, else from a decimal number, else from ``x,y,res``."""
    from hexloom.functions.geo import from_lonlat_at

    s = col(s)
    number = s.try_cast("long")
    t = parse_triple(s)
    # a point past the range of resolutions gives null
    return F.coalesce(from_hex(s), F.when(is_valid(number), number), from_lonlat_at(t["x"], t["y"], t["res"]))


# ---- directions --------------------------------------------------------------------------------------------------


def direction(c: Column | str) -> Column:
    """The digit at the id's own resolution; null at resolution 0 and where the digit is 7."""
    return direction_at(c, raw_resolution(c))


def direction_at(c: Column | str, r: int | Column) -> Column:
    """The digit at ``r``; null where ``r`` is 0 or finer than the id."""
    r = F.lit(r) if isinstance(r, int) else r
    d = digit(c, r)
    return F.when((r >= 1) & (r <= raw_resolution(c)) & (d < 7), d).cast("tinyint")


def direction_to_parent(c: Column | str) -> Column:
    """The digit of the id's parent, at the resolution above its own."""
    return direction_at(c, raw_resolution(c) - 1)


def directions(c: Column | str) -> Column:
    """All digits from resolution 1 to the id's own."""
    c = col(c)
    n = raw_resolution(c)
    every = F.array(*[digit(c, r).cast("tinyint") for r in range(1, 16)])
    return F.slice(every, F.lit(1), n)


def direction_from_number(n: Column | str) -> Column:
    """0 to 6 as a direction, null for other numbers."""
    return F.when(col(n).between(0, 6), col(n)).cast("tinyint")


# ---- edges -------------------------------------------------------------------------------------------------------

_EDGE_HEAD = ~(127 << 56)


def edge_origin(e: Column | str) -> Column:
    return F.when(is_valid_edge(e), raw_edge_origin(e))


def raw_edge_origin(e: Column | str) -> Column:
    return col(e).bitwiseAND(_long(_EDGE_HEAD)).bitwiseOR(_long(1 << 59))


def edge_direction(e: Column | str) -> Column:
    return shr(col(e), 56).bitwiseAND(F.lit(7)).cast("int")


def is_valid_edge(e: Column | str) -> Column:
    e = col(e)
    o, d = raw_edge_origin(e), edge_direction(e)
    return (e > 0) & (shr(e, 59).bitwiseAND(F.lit(15)) == 2) & d.between(1, 6) & is_valid(o) & ~(is_pentagon(o) & (d == 1))


def outgoing_edges(c: Column | str) -> Column:
    """The directed edges that start at a cell: 6, or 5 at a pentagon."""
    c = col(c)
    head = c.bitwiseAND(_long(_EDGE_HEAD)).bitwiseOR(_long(2 << 59))
    every = F.array(*[head.bitwiseOR(_long(d << 56)) for d in range(1, 7)])
    return F.when(is_valid(c), F.when(is_pentagon(c), F.slice(every, 2, 5)).otherwise(every))


# ---- constants ---------------------------------------------------------------------------------------------------


def _by_resolution(values, r: int | Column) -> Column:
    r = F.lit(r) if isinstance(r, int) else r
    return F.when(r.between(0, 15), F.get(F.array(*[F.lit(float(v)) for v in values]), r.cast("int")))


def area_avg_km2(r: int | Column) -> Column:
    from hexloom.kernel.cells import AREA_KM2

    return _by_resolution(AREA_KM2, r)


def area_avg_m2(r: int | Column) -> Column:
    return area_avg_km2(r) * 1e6


def edge_length_avg_km(r: int | Column) -> Column:
    from hexloom.kernel.cells import EDGE_KM

    return _by_resolution(EDGE_KM, r)


def edge_length_avg_m(r: int | Column) -> Column:
    return edge_length_avg_km(r) * 1000.0


def centroid_distance_avg_m(r: int | Column) -> Column:
    return edge_length_avg_m(r) * F.sqrt(F.lit(3.0))


def num_cells(r: int | Column) -> Column:
    r = F.lit(r) if isinstance(r, int) else r
    return (F.lit(2) + F.lit(120) * F.pow(F.lit(7), r)).cast("long")


def max_disk_size(k: int | Column) -> Column:
    k = _long(k)
    return k * (k + 1) * 3 + 1


RES0_COUNT, PENTAGON_COUNT = 122, 12


def base_id(b: int | Column) -> Column:
    """The resolution 0 cell of a base cell number."""
    return shl(_long(b), 45).bitwiseOR(_long((1 << 59) | DIGIT_MASK))


def res0_cells(spark):
    """All 122 cells of resolution 0."""
    return spark.range(RES0_COUNT).select(base_id(F.col("id")).alias("cell"))


def pentagons(spark, r: int):
    """The 12 pentagons of a resolution."""
    return spark.createDataFrame([(b,) for b in PENTAGONS], "b int").select(center_child(base_id(F.col("b")), r).alias("cell"))


def great_circle_rads(lon1, lat1, lon2, lat2) -> Column:
    """Haversine distance of points in degrees."""
    lon1, lat1, lon2, lat2 = (F.radians(col(c)) for c in (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def great_circle_km(lon1, lat1, lon2, lat2) -> Column:
    return great_circle_rads(lon1, lat1, lon2, lat2) * 6371.007180918475


def great_circle_m(lon1, lat1, lon2, lat2) -> Column:
    return great_circle_km(lon1, lat1, lon2, lat2) * 1000.0


def ij_add(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.struct((a["i"] + b["i"]).alias("i"), (a["j"] + b["j"]).alias("j"))


def ij_sub(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.struct((a["i"] - b["i"]).alias("i"), (a["j"] - b["j"]).alias("j"))
