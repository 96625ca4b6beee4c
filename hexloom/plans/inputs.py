"""Cells, edges and points made from the driver's tables, in both engines' terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.functions.bits import base7

SPREAD = 7**7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` to all cores: a file of one row group, which is small, but of rows that cost much, would
    be one task's work."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 4, key)


def _cell(base: Column, n: Column, r: int) -> Column:
    head = F.shiftleft(base.cast("long"), 45).bitwiseOR(F.lit((1 << 59) | (r << 52) | ((1 << ((15 - r) * 3)) - 1)))
    return head.bitwiseOR(F.shiftleft(base7(n), (15 - r) * 3))


def lineitem_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution 7 cells of base cells 0 to 3 from the keys of ``lineitem``."""
    n = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber")) % SPREAD
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", _cell(F.col("l_suppkey") % 4, n, 7).alias("cell"))


def _sql_cell(base: str, n: str, r: int) -> str:
    digits = " | ".join(f"(((({n}) // {7**t}) % 7) << {(15 - r + t) * 3})" for t in range(r))
    return f"((({base}) << 45) | {(1 << 59) | (r << 52) | ((1 << ((15 - r) * 3)) - 1)} | {digits})"


LINEITEM_CELLS = f"""cells AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  {_sql_cell("l_suppkey % 4", f"(l_orderkey * 7919 + l_partkey * 104729 + l_linenumber) % {SPREAD}", 7)} AS cell FROM lineitem)"""


def mixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, nulls and invalid ids."""
    c = F.when(F.col("l_linenumber") == 3, F.lit(None).cast("long")).when(F.col("l_linenumber") == 2, F.lit(55).cast("long")).when(F.col("l_linenumber") == 1, F.col("cell").bitwiseOR(F.lit(7 << 24))).otherwise(F.col("cell"))
    return lineitem_cells(spark, sf_dir).select("l_orderkey", "l_linenumber", c.alias("cell"))


MIXED_IDS = f"""{LINEITEM_CELLS}, ids AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 3 THEN NULL WHEN 2 THEN 55 WHEN 1 THEN cell | {7 << 24} ELSE cell END AS cell FROM cells)"""


def part_cells(spark: SparkSession, sf_dir: str, r: int = 3) -> DataFrame:
    """Cells of a coarse resolution, one to three from each part: dense enough to compact and to cluster."""
    n = F.col("p_partkey") % (7**r)
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", _cell(F.col("p_partkey") % 4, n, r).alias("cell"))


def part_cells_sql(r: int = 3) -> str:
    return f"cells AS (SELECT p_partkey, p_size, {_sql_cell('p_partkey % 4', f'p_partkey % {7**r}', r)} AS cell FROM part)"


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each customer."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", ((k * 7919 % 36000) / 100.0 - 180.0).alias("lon"), ((k * 104729 % 17000) / 100.0 - 85.0).alias("lat"))


CUSTOMER_POINTS = "points AS (SELECT c_custkey, c_acctbal, (c_custkey * 7919 % 36000) / 100.0 - 180.0 AS lon, (c_custkey * 104729 % 17000) / 100.0 - 85.0 AS lat FROM customer)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed graph of nation keys and customers, told by orders: from a customer's nation on, weight by status."""
    o = table(spark, sf_dir, "orders")
    a, b = F.col("o_custkey") % 40, (F.col("o_custkey") * 7 + F.col("o_orderkey")) % 40
    rows = o.select(a.cast("long").alias("origin"), b.cast("long").alias("destination"), (F.col("o_orderkey") % 9 + 1).cast("long").alias("weight")).filter("origin <> destination")
    return rows.withColumn("edge", F.col("origin") * 1000 + F.col("destination"))


LINKS = """links AS (SELECT o_custkey % 40 AS origin, (o_custkey * 7 + o_orderkey) % 40 AS destination, o_orderkey % 9 + 1 AS weight,
  (o_custkey % 40) * 1000 + (o_custkey * 7 + o_orderkey) % 40 AS edge FROM orders WHERE o_custkey % 40 <> (o_custkey * 7 + o_orderkey) % 40)"""
