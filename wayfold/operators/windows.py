"""Windows of snapshots and interpolation on time grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lambda_windows(times: DataFrame, size: int) -> DataFrame:
    """``p, p_start, p_end``: windows of ``size`` distinct times, each beginning where the last one ends; the last may be short.

    A single time makes no window.  There is a row per distinct time, of which one task numbers them.
    """
    if size < 2:
        raise ValueError("a window has at least two times")
    order = Window.orderBy("time")
    nth = times.select("time").where("time is not null").distinct().withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    starts = nth.where((F.pmod("i", F.lit(size - 1)) == 0) & (F.col("i") < F.col("n") - 1))
    starts = starts.select((F.col("i") / (size - 1)).cast("int").alias("p"), F.col("time").alias("p_start"), F.least(F.col("i") + size - 1, F.col("n") - 1).alias("j"))
    return starts.join(nth.select(F.col("i").alias("j"), F.col("time").alias("p_end")), "j").select("p", "p_start", "p_end")


def fixed_windows(times: DataFrame, minutes: int, closed: bool = True) -> DataFrame:
    """``p, p_start, p_end``: windows of a fixed length from the first time on, while they begin no later than the last
    time, or before it if not ``closed``."""
    ends = times.agg(F.min("time").alias("a"), F.max("time").alias("b"))
    begin = F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {minutes} MINUTES"))).alias("p_start")
    rows = ends.select(begin, "b")
    rows = rows if closed else rows.where("p_start < b")
    return rows.select((F.row_number().over(Window.orderBy("p_start")) - 1).alias("p"), "p_start", (F.col("p_start") + F.expr(f"INTERVAL {minutes} MINUTES")).alias("p_end"))


def interpolate(points: DataFrame, spans: DataFrame, step: str = "10 minutes", reach_out: bool = False) -> DataFrame:
    """Points of ``spans`` (``track, id, start_time, end_time``) on the grid that begins at each span's start.

    A grid time gets the straight line in time between the points before and after it; without one of them it is left out.
    Only points of the closed span count, and with ``reach_out`` the last one before and the first one after it as well.
    """
    grid = spans.select("track", "id", F.explode(F.sequence("start_time", "end_time", F.expr(f"INTERVAL {step}"))).alias("time"))
    inside = F.col("time").between(F.col("start_time"), F.col("end_time"))
    met = spans.join(points.select("id", "time", "x", "y").where("x is not null and y is not null"), "id")
    if reach_out:
        before = F.max(F.when(F.col("time") < F.col("start_time"), F.col("time"))).over(Window.partitionBy("track", "id"))
        after = F.min(F.when(F.col("time") > F.col("end_time"), F.col("time"))).over(Window.partitionBy("track", "id"))
        met = met.withColumns({"before": before, "after": after}).where(inside | (F.col("time") == F.col("before")) | (F.col("time") == F.col("after")))
    else:
        met = met.where(inside)
    known = met.groupBy("track", "id", "time").agg(F.min(F.struct("x", "y")).alias("q"))
    none = F.lit(None).cast("double")
    both = known.select("track", "id", "time", F.col("q.x").alias("x"), F.col("q.y").alias("y"), F.lit(False).alias("g"))
    both = both.unionByName(grid.select("track", "id", "time", none.alias("x"), none.alias("y"), F.lit(True).alias("g")))
    both = both.groupBy("track", "id", "time").agg(F.max("x").alias("x"), F.max("y").alias("y"), F.max("g").alias("g"))
    seen = F.when(F.col("x").isNotNull(), F.struct("time", "x", "y"))
    line = Window.partitionBy("track", "id").orderBy("time")
    rows = both.withColumns({"lo": F.last(seen, True).over(line.rowsBetween(Window.unboundedPreceding, 0)), "hi": F.first(seen, True).over(line.rowsBetween(0, Window.unboundedFollowing))})
    span = F.unix_micros("hi.time") - F.unix_micros("lo.time")
    part = F.when(span == 0, F.lit(0.0)).otherwise((F.unix_micros("time") - F.unix_micros("lo.time")) / span)
    value = lambda c: F.col(f"lo.{c}") + (F.col(f"hi.{c}") - F.col(f"lo.{c}")) * part
    return rows.where("g and lo is not null and hi is not null").select("track", "id", "time", value("x").alias("x"), value("y").alias("y"))
