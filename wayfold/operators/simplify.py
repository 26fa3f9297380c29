"""Douglas-Peucker simplification and segments with their tolerance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _gaps(x, y, i, j, line: bool) -> np.ndarray:
    """Distances of the points between i and j to the segment, or to the line, from i to j."""
    px, py = x[i + 1 : j], y[i + 1 : j]
    dx, dy = x[j] - x[i], y[j] - y[i]
    size = dx * dx + dy * dy
    if size == 0:
        return np.hypot(px - x[i], py - y[i])
    if line:
        return np.abs(dx * (y[i] - py) - (x[i] - px) * dy) / np.sqrt(size)
    t = np.clip(((px - x[i]) * dx + (py - y[i]) * dy) / size, 0, 1)
    return np.hypot(px - (x[i] + t * dx), py - (y[i] + t * dy))


def kept_points(x: np.ndarray, y: np.ndarray, delta: float, line: bool = False) -> np.ndarray:
    """Which points stay: a span is split at its farthest point, the earliest of equals, while that is farther than delta."""
    keep = np.zeros(len(x), bool)
    if len(x):
        keep[[0, -1]] = True
    spans = [(0, len(x) - 1)]
    while spans:
        i, j = spans.pop()
        if j - i > 1:
            d = _gaps(x, y, i, j, line)
            k = int(np.argmax(d))
            if d[k] > delta:
                keep[i + 1 + k] = True
                spans += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def simplify(df: DataFrame, delta: float, line: bool = False) -> DataFrame:
    """``id, time, x, y, kept, tolerance``: tolerance is that of the segment which begins at a kept point.

    Points without a time or a coordinate are left out; of several points of one time the least by x and y stays.
    """

    def one(table: pa.Table) -> pa.Table:
        """The rows of whole objects in order."""
        ids, time = table.column("id").to_numpy(), table.column("time").cast(pa.int64()).to_numpy()
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (time[1:] != time[:-1])
        table, ids = table.filter(pa.array(fresh)), ids[fresh]
        x, y = (table.column(c).to_numpy() for c in "xy")
        begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        keep, tolerance = np.zeros(len(ids), bool), np.full(len(ids), np.nan)
        for first, end in zip(begin.tolist(), [*begin[1:].tolist(), len(ids)]):
            own = kept_points(x[first:end], y[first:end], delta, line)
            keep[first:end] = own
            at = (np.flatnonzero(own) + first).tolist()
            for i, j in zip(at[:-1], at[1:]):
                tolerance[i] = _gaps(x, y, i, j, False).max(initial=0.0) if j - i > 1 else 0.0
        time = table.column("time").cast(pa.timestamp("us", "UTC"))
        return pa.table([table.column("id"), time, table.column("x"), table.column("y"), pa.array(keep), pa.array(tolerance)], names=["id", "time", "x", "y", "kept", "tolerance"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of an object that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))
            if cut or (held and held[0].column("id")[0].as_py() != ids[0]):
                yield from one(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches()
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from one(pa.Table.from_batches(held)).to_batches()

    whole = df.select(F.col("id").cast("long").alias("id"), "time", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("id is not null and time is not null and x is not null and y is not null")
    # Many objects a task, since a call of a grouped function for each costs more than its points.
    dealt = whole.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id", "time", "x", "y")
    return dealt.mapInArrow(run, "id long, time timestamp, x double, y double, kept boolean, tolerance double")


def segments(points: DataFrame) -> DataFrame:
    """``id, t0, t1, x0, y0, x1, y1, tolerance`` between kept points that follow each other; objects with one point have none."""
    order = Window.partitionBy("id").orderBy("time")
    tolerance = F.col("tolerance") if "tolerance" in points.columns else F.lit(0.0)
    rows = points.where("kept") if "kept" in points.columns else points
    out = rows.select("id", F.col("time").alias("t0"), F.lead("time").over(order).alias("t1"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(order).alias("x1"), F.lead("y").over(order).alias("y1"), tolerance.alias("tolerance"))
    return out.where("t1 is not null and t0 != t1")


def simplification_stats(points: DataFrame) -> DataFrame:
    from ..functions.values import reduction_percent

    kept = F.sum(F.col("kept").cast("long"))
    return points.agg(F.count(F.lit(1)).alias("n_points"), kept.alias("n_kept"), reduction_percent(F.count(F.lit(1)), kept).alias("reduction_percent"))
