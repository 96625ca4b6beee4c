"""Streams keyed by cell. The column functions are stateless and work on streams unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions import bits as B


def windowed_parents(stream: DataFrame, cell: str, ts: str, r: int, window: str = "10 minutes", late: str = "1 hour", value: str | None = None) -> DataFrame:
    """Counts (and sums of ``value``) by event-time window and ancestor; rows later than ``late`` are left out."""
    up = stream.withWatermark(ts, late).withColumn("parent", B.parent(cell, r)).filter("parent IS NOT NULL")
    sums = [F.sum(value).alias("total")] if value else []
    return up.groupBy(F.window(ts, window), "parent").agg(F.count("*").alias("n"), *sums)
