"""Points as a stream: binned with a watermark, one row per object and bin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binned_stream(points: DataFrame, minutes: int = 10, late: str = "30 minutes") -> DataFrame:
    """The earliest point of each object in each bin; bins end in append mode once the watermark passes them."""
    bins = F.window("time", f"{minutes} minutes")
    return points.withWatermark("time", late).groupBy(bins, "id").agg(F.min(F.struct("time", "x", "y")).alias("q")).select("id", F.col("window.start").alias("time"), F.col("q.x").alias("x"), F.col("q.y").alias("y"))
