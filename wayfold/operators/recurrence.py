"""Recurrent clusters: by shared members, and by boxes and Hausdorff distance; coverage of one method by another."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..store import once


def numbered_members(members: DataFrame) -> DataFrame:
    """``seq, time, label, id``: clusters numbered by time and label.

    Clusters are numbered within their time; one task adds up the counts of the times.
    """
    own = members.select("time", "label", "id").distinct()
    nth = own.select("time", "label").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("time").orderBy("label")))
    before = Window.orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    starts = nth.groupBy("time").agg(F.count(F.lit(1)).alias("c")).select("time", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    numbers = nth.join(starts, "time").select("time", "label", (F.col("start") + F.col("nth")).alias("seq"))
    return own.join(numbers, ["time", "label"])


def shared_members(members: DataFrame, tau: int) -> DataFrame:
    """``earlier, later, shared``: clusters that share at least tau objects, found through their members."""
    b = members.select(F.col("seq").alias("earlier"), "id")
    return members.select(F.col("seq").alias("later"), "id").join(b, "id").where("earlier < later").groupBy("earlier", "later").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= tau)


def cluster_boxes(members: DataFrame, points: DataFrame) -> DataFrame:
    return members.join(points, ["time", "id"]).groupBy("seq").agg(F.min("x").alias("lo_x"), F.max("x").alias("hi_x"), F.min("y").alias("lo_y"), F.max("y").alias("hi_y"))


def box_overlaps(boxes: DataFrame, cell: float = 100.0) -> DataFrame:
    """``earlier, later``: pairs whose closed boxes meet, joined in the first grid cell that both have."""
    floor = lambda c: F.floor(F.col(c) / cell)
    spread = boxes.withColumns({"fx": floor("lo_x"), "fy": floor("lo_y")})
    spread = spread.withColumn("cx", F.explode(F.sequence("fx", floor("hi_x")))).withColumn("cy", F.explode(F.sequence("fy", floor("hi_y"))))
    names = ("seq", "lo_x", "hi_x", "lo_y", "hi_y", "fx", "fy")
    a, b = (spread.select("cx", "cy", *(F.col(n).alias(f"{s}_{n}") for n in names)) for s in "ab")
    meet = F.expr("a_seq < b_seq AND a_lo_x <= b_hi_x AND b_lo_x <= a_hi_x AND a_lo_y <= b_hi_y AND b_lo_y <= a_hi_y")
    first = (F.col("cx") == F.greatest("a_fx", "b_fx")) & (F.col("cy") == F.greatest("a_fy", "b_fy"))
    return a.join(b, ["cx", "cy"]).where(meet & first).select(F.col("a_seq").alias("earlier"), F.col("b_seq").alias("later"))


#: Points of a leaf.
LEAF = 64


def _leaves(at: np.ndarray) -> list[np.ndarray]:
    """Places cut in halves along the longer side of their box, down to leaves."""
    todo, out = [at], []
    while todo:
        part = todo.pop()
        if len(part) <= LEAF:
            out.append(part)
            continue
        k = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        part = part[np.argpartition(part[:, k], len(part) // 2)]
        todo += [part[: len(part) // 2], part[len(part) // 2 :]]
    return out


def _nearest(a: np.ndarray, leaves: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each of the near-by places ``a`` the distance to the nearest place of the leaves, of which only those are tried that may hold it."""
    lo, hi = a.min(axis=0), a.max(axis=0)
    least = np.sqrt((np.maximum(np.maximum(low - hi, lo - high), 0) ** 2).sum(axis=1))
    most = np.sqrt((np.maximum(hi - low, high - lo) ** 2).sum(axis=1)).min()
    b = np.concatenate([leaves[k] for k in np.flatnonzero(least <= most * (1 + 1e-9)).tolist()])
    best = np.full(len(a), np.inf)
    for start in range(0, len(b), 1 << 14):
        dx, dy = (a[:, k, None] - b[None, start : start + (1 << 14), k] for k in (0, 1))
        best = np.minimum(best, np.sqrt(dx * dx + dy * dy).min(axis=1))
    return best


class _Cluster:
    """The places of a cluster, each with an object or -1 if it is its object's only one."""

    def __init__(self, ids: np.ndarray, at: np.ndarray):
        self.leaves = _leaves(np.column_stack((at, ids)))
        self.places = [leaf[:, :2] for leaf in self.leaves]
        self.low, self.high = (np.array([f(p, axis=0) for p in self.places]) for f in (np.min, np.max))

    def farthest(self, other: _Cluster) -> float:
        """The most that an object of this one is away from the other."""
        d = np.concatenate([_nearest(p, other.places, other.low, other.high) for p in self.places])
        own = np.concatenate([leaf[:, 2] for leaf in self.leaves])
        some = own >= 0
        if not some.any():
            return float(d.max())
        _, back = np.unique(own[some], return_inverse=True)
        least = np.full(back.max() + 1, np.inf)
        np.minimum.at(least, back, d[some])
        return float(max(least.max(), d[~some].max(initial=0.0)))


def hausdorff(pairs: DataFrame, members: DataFrame, points: DataFrame) -> DataFrame:
    """``earlier, later, hausdorff``: the larger of both directed distances.

    Clusters are dealt to blocks, and a group is a pair of blocks: a cluster's places are sent once to each block, not once for each
    pair.  Equal places count once, and a place is held against the leaves of the other cluster that may be nearest.
    """
    at = members.join(points, ["time", "id"]).where("x is not null and y is not null").groupBy("seq", "id").agg(F.collect_set(F.struct("x", "y")).alias("q"))
    # Objects of several places at a time are numbered in their cluster: the nearest place is the object's.
    several = F.when(F.size("q") > 1, F.col("id"))
    at = at.select("seq", several.alias("several"), F.explode("q").alias("q")).distinct()
    rank = F.dense_rank().over(Window.partitionBy("seq").orderBy("several"))
    at = at.select("seq", F.when(F.col("several").isNull(), F.lit(-1)).otherwise(rank).cast("long").alias("id"), F.col("q.x").alias("x"), F.col("q.y").alias("y"))
    blocks = math.ceil(math.sqrt(2 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(blocks)).cast("int")
    keys = lambda a, b: (F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    asked = pairs.select(F.col("earlier").cast("long").alias("earlier"), F.col("later").cast("long").alias("later"), *keys(block("earlier"), block("later")))
    sent = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.col("seq").cast("long").alias("seq"), "id", "x", "y", *keys(block("seq"), F.col("other")))

    def run(wanted: pa.Table, places: pa.Table) -> pa.Table:
        a, b = (wanted.column(c).to_numpy() for c in ("earlier", "later"))
        seq, ids, x, y = (places.column(c).to_numpy() for c in ("seq", "id", "x", "y"))
        order = np.argsort(seq, kind="stable")
        seq, ids, spot = seq[order], ids[order], np.column_stack((x, y))[order]
        made: dict[int, _Cluster] = {}

        def cluster(k: int) -> _Cluster:
            if k not in made:
                i, j = np.searchsorted(seq, [k, k + 1])
                made[k] = _Cluster(ids[i:j], spot[i:j])
            return made[k]

        far = [max(cluster(i).farthest(cluster(j)), cluster(j).farthest(cluster(i))) for i, j in zip(a.tolist(), b.tolist())]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(far, pa.float64())], names=["earlier", "later", "hausdorff"])

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = (df.repartition(n, "lo", "hi").groupBy("lo", "hi") for df in (asked, sent))
    return next(both).cogroup(next(both)).applyInArrow(run, "earlier long, later long, hausdorff double")


def coverage(exact: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each exact convoy, and whether a candidate with a common time holds all its objects.

    A candidate holds a convoy if as many objects meet in a join by object as the convoy has, so no set is sent along with each member.
    """
    exact = once(exact)
    names = ("objects", "start_time", "end_time")
    asked = once(exact.select(*names).distinct().withColumn("convoy", F.monotonically_increasing_id()).withColumn("n", F.size(F.array_distinct("objects"))))
    own = asked.select("convoy", "n", "start_time", "end_time", F.explode(F.array_distinct("objects")).alias("member"))
    held = once(candidates.select(F.monotonically_increasing_id().alias("held"), F.array_distinct("objects").alias("objects"), F.col("start_time").alias("c_start"), F.col("end_time").alias("c_end")))
    held = held.select("held", "c_start", "c_end", F.explode("objects").alias("member"))
    met = own.join(held.hint("merge"), "member").where(geo.overlap(F.col("start_time"), F.col("end_time"), F.col("c_start"), F.col("c_end")))
    whole = met.groupBy("convoy", "held").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n")).where("shared = n").select("convoy").distinct()
    covered = asked.join(whole, "convoy", "left_semi").select(*names, F.lit(True).alias("covered"))
    return exact.join(covered, list(names), "left").select(*names, "lifetime_points", F.coalesce("covered", F.lit(False)).alias("covered"))
