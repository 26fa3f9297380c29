"""Convoys: exactly, snapshot by snapshot; and by a filter on simplified trajectories with refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import round_time
from ..operators.dbscan import cluster_sets
from ..operators.dense import link_clusters, point_clusters, segment_links
from ..operators.joins import assign_windows, numbered_segments
from ..operators.simplify import segments, simplify
from ..operators.tracker import active_counts, track
from ..operators.windows import fixed_windows, interpolate, lambda_windows
from ..store import once


def snapshot_members(points: DataFrame, eps: float, m: int, geographic: bool = False) -> DataFrame:
    return point_clusters(points, eps, m, "time", geographic)


def cmc(points: DataFrame, m: int, k: int, eps: float, geographic: bool = False) -> DataFrame:
    """``objects, start_time, end_time, lifetime_points`` of all convoys; a time without points doesn't break one."""
    sets = cluster_sets(snapshot_members(points, eps, m, geographic))
    steps = points.select("time").distinct().join(sets, "time", "left")
    rows = steps.select(F.lit(0).alias("track"), F.col("time").alias("start"), F.col("time").alias("end"), F.lit(1).alias("points"), "objects")
    return track(rows, m, k, dedupe=False).drop("track")


def partition_clusters(points: DataFrame, m: int, eps: float, delta: float, size: int, cell: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The windows, ``p, label, id`` of their trajectory clusters, and the segments in them, simplified once."""
    windows = lambda_windows(points, size)
    parts = assign_windows(once(segments(simplify(points, delta))), windows)
    return windows, link_clusters(segment_links(parts, "id", eps, cell, m), m, "p", drop_small=True), parts


def _filter_steps(windows: DataFrame, members: DataFrame, size: int) -> DataFrame:
    sets = windows.join(cluster_sets(members, "p"), "p", "left")
    return sets.select(F.lit(0).alias("track"), F.col("p_start").alias("start"), F.col("p_end").alias("end"), F.lit(size).alias("points"), "objects")


def cuts_filter(points: DataFrame, m: int, k: int, eps: float, delta: float, size: int, cell: float) -> DataFrame:
    """Candidates: ``candidate, objects, start_time, end_time, lifetime_points``; of equal ones by rounded times the longest."""
    windows, members, _ = partition_clusters(points, m, eps, delta, size, cell)
    found = track(_filter_steps(windows, members, size), m, k, new_needs_m=True).drop("track")
    same = Window.partitionBy("objects", round_time(F.col("start_time"), 10), round_time(F.col("end_time"), 10)).orderBy(F.desc("lifetime_points"), "start_time", "end_time")
    best = found.withColumn("rn", F.row_number().over(same)).where("rn = 1").drop("rn")
    return best.withColumn("candidate", F.row_number().over(Window.orderBy("start_time", "end_time", "objects")))  # candidates are few


def filter_log(points: DataFrame, m: int, k: int, eps: float, delta: float, size: int, cell: float) -> DataFrame:
    """Per window: its bounds, the objects with segments in it, its clusters, and the candidates followed after it."""
    windows, members, parts = partition_clusters(points, m, eps, delta, size, cell)
    members = once(members)
    objects = parts.groupBy("p").agg(F.countDistinct("id").alias("objects_in_partition"))
    found = members.groupBy("p").agg(F.countDistinct("label").alias("filter_clusters"))
    active = active_counts(_filter_steps(windows, members, size), m, k, new_needs_m=True).withColumnRenamed("start", "p_start")
    rows = windows.join(objects, "p", "left").join(found, "p", "left").join(active, "p_start", "left")
    counts = ("objects_in_partition", "filter_clusters", "active_candidates")
    return rows.select("p", "p_start", "p_end", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def refine(points: DataFrame, candidates: DataFrame, m: int, k: int, eps: float, step: str = "10 minutes") -> DataFrame:
    """Exact convoys among each candidate's own objects, all candidates at once."""
    spans = candidates.select(F.col("candidate").alias("track"), F.explode("objects").alias("id"), "start_time", "end_time")
    grid = once(interpolate(points, spans, step))
    snaps = grid.withColumn("snap", F.concat_ws("|", "track", F.unix_micros("time").cast("string")))
    sets = cluster_sets(point_clusters(snaps, eps, m, "snap", drop_small=True, alone=False), "snap")
    steps = grid.select("track", "time").distinct().withColumn("snap", F.concat_ws("|", "track", F.unix_micros("time").cast("string")))
    rows = steps.join(sets, "snap", "left").select("track", F.col("time").alias("start"), F.col("time").alias("end"), F.lit(1).alias("points"), "objects")
    found = track(rows, m, k).where(F.size("objects") >= m)
    return found.groupBy("objects", "start_time", "end_time").agg(F.max("lifetime_points").alias("lifetime_points"))


def cuts(points: DataFrame, m: int, k: int, eps: float, delta: float, size: int, cell: float, step: str = "10 minutes") -> DataFrame:
    return refine(points, once(cuts_filter(points, m, k, eps, delta, size, cell)), m, k, eps, step)


def segment_clusters(points: DataFrame, m: int, eps: float, delta: float, minutes: int, cell: float, distance: str = "ends", temporal: bool = False, drop_small: bool = False, closed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Windows of a fixed length, and ``p, objects``: the objects of each cluster of single segments.

    A segment's neighbours may be of its own object; ``drop_small`` leaves out clusters of fewer than m objects.
    """
    windows = fixed_windows(points, minutes, closed)
    parts = once(numbered_segments(assign_windows(segments(simplify(points, delta)), windows)))
    members = link_clusters(segment_links(parts, "seg", eps, cell, m, distance, temporal), m, "p")
    owners = members.join(parts.select("p", F.col("seg").alias("id"), F.col("id").alias("object")), ["p", "id"])
    sets = owners.groupBy("p", "label").agg(F.array_sort(F.collect_set("object")).alias("objects")).select("p", "objects")
    return windows, sets.where(F.size("objects") >= m) if drop_small else sets


def minutes_filter(points: DataFrame, m: int, k: int, eps: float, delta: float, minutes: int, cell: float, **options) -> DataFrame:
    """Candidates of the filter on windows of ``minutes`` and single segments, k windows long at least; equal ones stay.

    ``options`` are those of :func:`segment_clusters`.  ``lifetime_points`` counts windows.
    """
    windows, sets = segment_clusters(points, m, eps, delta, minutes, cell, **options)
    rows = windows.join(sets, "p", "left").select(F.lit(0).alias("track"), F.col("p_start").alias("start"), F.col("p_end").alias("end"), F.lit(1).alias("points"), "objects")
    found = track(rows, m, k, dedupe=False).drop("track")
    return found.withColumn("candidate", F.row_number().over(Window.orderBy("start_time", "end_time", "objects")))  # candidates are few


def refine_by_cmc(points: DataFrame, candidates: DataFrame, m: int, k: int, eps: float, geographic: bool = False, buffer_minutes: int = 0, dedupe: bool = False) -> DataFrame:
    """Exact convoys among each candidate's own objects at the times that were observed, all candidates at once.

    ``buffer_minutes`` widens a candidate's time at both ends; ``dedupe`` keeps one of equal convoys of several candidates.
    """
    wider = F.expr(f"INTERVAL {buffer_minutes} MINUTES")
    spans = candidates.select(F.col("candidate").alias("track"), F.explode("objects").alias("id"), (F.col("start_time") - wider).alias("s"), (F.col("end_time") + wider).alias("e"))
    own = points.join(spans, "id").where(F.col("time").between(F.col("s"), F.col("e")))
    own = own.withColumn("snap", F.concat_ws("|", "track", F.unix_micros("time").cast("string")))
    sets = cluster_sets(point_clusters(own, eps, m, "snap", geographic, alone=False), "snap")
    steps = own.select("track", "time", "snap").distinct().join(sets, "snap", "left")
    rows = steps.select("track", F.col("time").alias("start"), F.col("time").alias("end"), F.lit(1).alias("points"), "objects")
    found = track(rows, m, k, dedupe=False).drop("track")
    if not dedupe:
        return found
    return found.groupBy("objects", "start_time", "end_time").agg(F.max("lifetime_points").alias("lifetime_points"))


def cuts_minutes(points: DataFrame, m: int, k_filter: int, k: int, eps: float, delta: float, minutes: int, cell: float, buffer_minutes: int = 0, dedupe: bool = False, **options) -> tuple[DataFrame, DataFrame]:
    """Convoys by the filter on windows of minutes with exact refinement, and the filter's candidates."""
    found = once(minutes_filter(points, m, k_filter, eps, delta, minutes, cell, **options))
    return refine_by_cmc(points, found, m, k, eps, buffer_minutes=buffer_minutes, dedupe=dedupe), found
