"""Activity over time: buckets, a grid of at most 60 columns, histograms."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000, 86_400_000
COLUMNS = 60


def buckets(points: DataFrame, unit: int, value: Column | None = None) -> DataFrame:
    """(bucket, source, value) of points (ts, source): sums, or counts without a value; a ts of 0 is unknown and left out."""
    value = F.count("*") if value is None else F.sum(value)
    return points.where("ts > 0").groupBy((F.col("ts") - F.col("ts") % unit).alias("bucket"), "source").agg(value.alias("value"))


def merged(lists: Iterable[DataFrame]) -> DataFrame:
    """The raw buckets of several machines in one, before they are laid on a grid."""
    return reduce(DataFrame.unionByName, lists).groupBy("bucket", "source").agg(F.sum("value").alias("value"))


def step_of(start: int, end: int, unit: int) -> int:
    """The width of a column so that there are at most 60."""
    units = (end - start) // unit + 1
    return -(-units // COLUMNS) * unit


def regrid(raw: DataFrame, since: int, now: int, unit: int) -> DataFrame:
    """(bucket, source, value) on a grid that starts with since; raw buckets outside are left out."""
    end = now // unit * unit
    start = min(since // unit * unit, end)
    step = step_of(start, end, unit)
    on = raw.where(F.col("bucket").between(start, end)).withColumn("bucket", start + F.floor((F.col("bucket") - start) / step) * step)
    return on.groupBy("bucket", "source").agg(F.sum("value").alias("value"))


def grid(spark, since: int, now: int, unit: int) -> DataFrame:
    """All bucket starts of the grid, those without values too."""
    end = now // unit * unit
    start = min(since // unit * unit, end)
    return spark.range(start, end + 1, step_of(start, end, unit)).withColumnRenamed("id", "bucket")


def histogram(points: DataFrame, column: str, low: int, high: int, width: int) -> DataFrame:
    """(idx, n) of ``width`` equal parts of [low, high]; the last takes the upper bound, points outside are left out."""
    span = max(1, high - low)
    idx = F.least(F.floor((F.col(column) - low) * width / span), F.lit(width - 1))
    return points.where(F.col(column).between(low, high)).groupBy(idx.cast("int").alias("idx")).agg(F.count("*").alias("n"))
