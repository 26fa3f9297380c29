"""From raw pings to clean, binned trajectories."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, to_planar
from ..functions.values import round_time
from .groups import grouped


def valid_points(df: DataFrame, least_x: float = 100.0, least_y: float = 30.0) -> DataFrame:
    return df.where((F.col("x") > least_x) & (F.col("y") > least_y))


def in_window(df: DataFrame, start, end) -> DataFrame:
    """Rows of the closed interval; the predicate reaches the scan."""
    return df.where(F.col("time").between(F.lit(start), F.lit(end)))


def day_window(df: DataFrame, day=None, start_hour: int = 13, hours: int = 5, start_minute: int = 0) -> DataFrame:
    """Rows of a day's hours; the first day of the data if none is given.  Raises if there are none."""
    first = F.lit(day).cast("timestamp") if day else df.agg(F.date_trunc("day", F.min("time")).alias("d")).first()["d"]
    begin = F.lit(first) + F.expr(f"INTERVAL {60 * start_hour + start_minute} MINUTES")
    out = df.where(F.col("time").between(begin, begin + F.expr(f"INTERVAL {hours} HOURS")))
    if out.isEmpty():
        raise ValueError("no points in the window")
    return out


def bin_and_dedupe(df: DataFrame, minutes: int = 10) -> DataFrame:
    """At most one point per object and bin, the earliest; equal times by coordinates."""
    binned = df.withColumn("bin", round_time(F.col("time"), minutes))
    first = F.row_number().over(Window.partitionBy("id", "bin").orderBy("time", "x", "y"))
    return binned.withColumn("rn", first).where("rn = 1").select("id", F.col("bin").alias("time"), "x", "y")


def distinct_points(df: DataFrame) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("id", "time").orderBy("x", "y"))
    return df.withColumn("rn", first).where("rn = 1").drop("rn")


def local_projection(df: DataFrame) -> DataFrame:
    """x and y in meters about the mean of all points: a one-row aggregate joined back."""
    mean = df.agg(F.avg("x").alias("lon0"), F.avg("y").alias("lat0"))  # one row
    x, y = to_planar(F.col("x"), F.col("y"), F.col("lon0"), F.col("lat0"))
    return df.join(F.broadcast(mean)).select("id", "time", x.alias("x"), y.alias("y"))


def object_order(df: DataFrame) -> DataFrame:
    """``id, nth``: objects by their first point in time (then by id), numbered from 0.  A row per object, of which one task numbers them."""
    first = df.groupBy("id").agg(F.min("time").alias("first_time"))
    return first.select("id", (F.row_number().over(Window.orderBy("first_time", "id")) - 1).alias("nth"))


def first_objects(df: DataFrame, n: int) -> DataFrame:
    """The points of the first ``n`` objects, a report of that many."""
    return df.join(object_order(df).where(F.col("nth") < n), "id", "left_semi")


def nth_object(df: DataFrame, n: int) -> DataFrame:
    """The points of object number ``n`` from 0; raises if there are not so many."""
    own = object_order(df).where(F.col("nth") == n)
    if n < 0 or own.isEmpty():
        raise IndexError(f"no object number {n}")
    return df.join(own, "id", "left_semi")


def trajectory_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("id").agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct("time").alias("n_times"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))


def _meters(lon1, lat1, lon2, lat2) -> float:
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1.0, math.sqrt(h)))


def _flat(x1, y1, x2, y2) -> float:
    return math.hypot(x2 - x1, y2 - y1)


def remove_stay_points(df: DataFrame, within: float = 50.0, minutes: float = 15.0, planar: bool = False) -> DataFrame:
    """Leave out pings of stays: from an anchor, the longest run that stays within a distance for at least some minutes.

    The scan is sequential, so each object's pings are one group.
    """
    far = _flat if planar else _meters

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["time", "x", "y"], kind="stable").reset_index(drop=True)
        xs, ys, ts = pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["time"].to_numpy("datetime64[us]").astype("int64")
        stay, i = [False] * len(pdf), 0
        while i < len(pdf):
            j = i + 1
            while j < len(pdf) and far(xs[i], ys[i], xs[j], ys[j]) <= within:
                j += 1
            if j - 1 > i and ts[j - 1] - ts[i] >= minutes * 60_000_000:
                stay[i:j] = [True] * (j - i)
                i = j
            else:
                i += 1
        return pdf[[not s for s in stay]]

    return grouped(df.select("id", "time", "x", "y"), "id").applyInPandas(run, df.select("id", "time", "x", "y").schema)
