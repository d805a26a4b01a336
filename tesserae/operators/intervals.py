"""Intervals [start, end): unions, overlaps, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coalesced(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of the ranges of each key; ranges that touch are joined."""
    # frames by value: ranges with the same start are in the same island, whatever their order
    order = Window.partitionBy(*keys).orderBy(start)
    reach = F.max(end).over(order.rangeBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.coalesce(F.col(start) > F.col("__reach"), F.lit(True)), F.col(start))
    islands = ranges.withColumn("__reach", reach).withColumn("__island", F.max(begins).over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_ranges")).drop("__island")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def binned(df: DataFrame, start: str, end: str, width: int, name: str = "bin") -> DataFrame:
    """One row for each bin of ``width`` that the range touches, so that overlap becomes an equal join with a filter."""
    last = F.greatest(F.col(end) - 1, F.col(start))
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))


def fixed_segments(ranges: DataFrame, width: int) -> DataFrame:
    """Ranges cut into pieces of ``width`` and a remainder."""
    cut = ranges.where("start < end").withColumn("s", F.explode(F.sequence("start", F.col("end") - 1, F.lit(width))))
    return cut.select(*[c for c in ranges.columns if c not in ("start", "end")], F.col("s").alias("start"), F.least(F.col("s") + width, "end").alias("end"))
