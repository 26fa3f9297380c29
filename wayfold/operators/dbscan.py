"""Density clusters of each key from its near pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import grouped


def core_points(pairs: DataFrame, m: int, key: str = "time") -> DataFrame:
    """``key, id, neighbours, core`` of the points that have a neighbour; neighbours count the point itself."""
    ends = pairs.select(key, F.explode(F.array("a", "b")).alias("id"))
    return ends.groupBy(key, "id").agg((F.count(F.lit(1)) + 1).alias("neighbours")).withColumn("core", F.col("neighbours") >= m)


def repeated(table: pa.Table, key: str, n: int) -> pa.Array:
    """The key of a group, n times; Spark hands times over in the session's zone and wants them back in UTC."""
    column = table.column(key).combine_chunks().take(pa.array(np.zeros(n, np.int64)))
    return column.cast(pa.timestamp("us", "UTC")) if pa.types.is_timestamp(column.type) and column.type.tz else column


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that the edges a-b lead to: rounds of hooking to the smaller label and of shortcuts."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while (label != label[label]).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def labelled(a: np.ndarray, b: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and labels of the clustered points, from the near pairs of one key."""
    ids, both = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = both[: len(a)], both[len(a) :]
    core = np.bincount(both, minlength=len(ids)) + 1 >= m
    joined = core[i] & core[j]
    label = smallest_reachable(len(ids), i[joined], j[joined])
    label[~core] = len(ids)
    for x, y in ((i, j), (j, i)):
        border = ~core[x] & core[y]
        np.minimum.at(label, x[border], label[y[border]])
    some = label < len(ids)
    return ids[some], ids[label[some]]


def clusters(pairs: DataFrame, m: int, key: str = "time", drop_small: bool = False, points: DataFrame | None = None) -> DataFrame:
    """``key, label, id``: the label is the smallest core id of the cluster.

    Core points joined by near pairs are one cluster; a border point goes to the cluster with the smallest label among its
    core neighbours, the rest is noise.  One shuffle by key; a group is the pairs of one key, as arrays.  ``drop_small`` leaves out
    clusters of fewer than m members.  With m = 1 a point without a neighbour is a cluster too: ``points`` (``key, id``) gives these.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, label = labelled(table.column("a").to_numpy(), table.column("b").to_numpy(), m)
        if drop_small and len(ids):
            _, back, count = np.unique(label, return_inverse=True, return_counts=True)
            ids, label = ids[count[back] >= m], label[count[back] >= m]
        return pa.table([repeated(table, key, len(ids)), pa.array(label, pa.int64()), pa.array(ids, pa.int64())], names=[key, "label", "id"])

    out = grouped(pairs.select(key, F.col("a").cast("long"), F.col("b").cast("long")), key).applyInArrow(run, f"{key} {dict(pairs.dtypes)[key]}, label long, id long")
    if m > 1 or points is None:
        return out
    alone = points.select(key, F.col("id").cast("long").alias("id")).distinct().join(out, [key, "id"], "left_anti")
    return out.unionByName(alone.select(key, F.col("id").alias("label"), "id"))


def cluster_sets(members: DataFrame, key: str = "time") -> DataFrame:
    return members.groupBy(key, "label").agg(F.array_sort(F.collect_set("id")).alias("objects"))
