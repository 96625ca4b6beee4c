"""OpenStreetMap extracts (PBF) as frames of nodes and ways, and road graphs from them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hexloom.functions import geo as X
from hexloom.operators import graph as GR

NODES = "id bigint, lon double, lat double"
WAYS = "id bigint, refs array<bigint>, tags map<string,string>"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        elif key & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _packed(data: bytes, signed: bool) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = _varint(data, at)
        out.append((v >> 1) ^ -(v & 1) if signed else v)
    return out


def _running(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += v
        out.append(total)
    return out


def parse_block(block: bytes) -> tuple[list[tuple], list[tuple]]:
    """Nodes and ways of one primitive block."""
    strings: list[str] = []
    groups, granularity, lat0, lon0 = [], 100, 0, 0
    for n, v in _fields(block):
        if n == 1:
            strings = [s.decode(errors="replace") for k, s in _fields(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            granularity = v
        elif n == 19:
            lat0 = v
        elif n == 20:
            lon0 = v
    nodes, ways = [], []
    degrees = lambda v, off: (off + granularity * v) * 1e-9
    for group in groups:
        for n, v in _fields(group):
            if n == 1:
                f = dict(_fields(v))
                zig = lambda x: (x >> 1) ^ -(x & 1)
                nodes.append((zig(f[1]), degrees(zig(f[9]), lon0), degrees(zig(f[8]), lat0)))
            elif n == 2:
                f = dict(_fields(v))
                ids, lats, lons = (_running(_packed(f[k], True)) for k in (1, 8, 9))
                nodes += [(i, degrees(x, lon0), degrees(y, lat0)) for i, y, x in zip(ids, lats, lons, strict=True)]
            elif n == 3:
                f = dict(_fields(v))
                keys, values = _packed(f.get(2, b""), False), _packed(f.get(3, b""), False)
                tags = {strings[k]: strings[w] for k, w in zip(keys, values, strict=True)}
                ways.append((f.get(1, 0), _running(_packed(f.get(8, b""), True)), tags))
    return nodes, ways


def blobs(raw: bytes) -> Iterator[bytes]:
    """The data blocks of a file's content."""
    at = 0
    while at < len(raw):
        n = struct.unpack(">I", raw[at : at + 4])[0]
        head = dict(_fields(raw[at + 4 : at + 4 + n]))
        at += 4 + n
        body = dict(_fields(raw[at : at + head[3]]))
        at += head[3]
        if head[1] == b"OSMData":
            yield zlib.decompress(body[3]) if 3 in body else body[1]


def read_pbf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of one or many files that Spark can read; a file is one task's work, so extracts should be split."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(which: int, kinds: list) -> Callable:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    for block in blobs(content.as_py()):
                        rows = parse_block(block)[which]
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array([list(v.items()) for v in c] if pa.types.is_map(t) else c, t) for c, t in zip(map(list, zip(*rows, strict=True)), kinds, strict=True)], names=[f"c{k}" for k in range(len(kinds))])

        return go

    nodes = files.mapInArrow(run(0, [pa.int64(), pa.float64(), pa.float64()]), "c0 bigint, c1 double, c2 double").toDF("id", "lon", "lat")
    ways = files.mapInArrow(run(1, [pa.int64(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string())]), "c0 bigint, c1 array<bigint>, c2 map<string,string>").toDF("id", "refs", "tags")
    return nodes, ways


# fixed values of the published road example: cost of a cell by kind of highway
ROAD_WEIGHTS = {
    "motorway": 3.0, "motorway_link": 3.0, "trunk": 3.0, "trunk_link": 3.0, "primary": 3.0, "primary_link": 3.0,
    "secondary": 4.0, "secondary_link": 4.0, "tertiary": 5.0, "tertiary_link": 5.0,
    "unclassified": 8.0, "residential": 8.0, "living_street": 8.0, "service": 8.0, "road": 9.0, "pedestrian": 50.0,
}


def road_weight(tags: Column) -> Column:
    """The weight of a way by its ``highway`` tag; null for other ways."""
    kind = F.lower(F.try_element_at(tags, F.lit("highway")))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ROAD_WEIGHTS.items() for x in kv]), kind)


def road_two_way(tags: Column) -> Column:
    return F.coalesce(F.lower(F.try_element_at(tags, F.lit("oneway"))) != "yes", F.lit(True))


def road_graph(nodes: DataFrame, ways: DataFrame, res: int, weight: Callable[[Column], Column] = road_weight, two_way: Callable[[Column], Column] = road_two_way) -> DataFrame:
    """A graph of the cells along the ways; ways without a weight, and references to unknown nodes, are left out."""
    w = ways.select("id", "refs", weight(F.col("tags")).alias("weight"), two_way(F.col("tags")).alias("both")).filter("weight IS NOT NULL")
    points = w.select("id", "weight", "both", F.posexplode("refs").alias("p", "ref")).join(nodes.select(F.col("id").alias("ref"), "lon", "lat"), "ref")
    lines = points.groupBy("id", "weight", "both").agg(F.array_sort(F.collect_list(F.struct("p", F.col("lon").alias("x"), F.col("lat").alias("y")))).alias("s")).filter(F.size("s") >= 2)
    cells = lines.select("id", "weight", "both", F.posexplode(X.line_cells(F.transform("s", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))), res)).alias("p", "cell"))
    order = Window.partitionBy("id").orderBy("p")
    steps = cells.withColumn("a", F.lag("cell").over(order)).filter("a IS NOT NULL AND a <> cell")
    pairs = steps.select("a", F.col("cell").alias("b"), "weight").unionByName(steps.filter("both").select(F.col("cell").alias("a"), F.col("a").alias("b"), "weight"))
    return GR.from_cells(pairs, "a", "b", "weight")
