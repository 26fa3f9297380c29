"""Shards of near-equal bytes: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, in_written_order, written

#: The first cells are so many parts of the range of a text hash, by its leading bits; one that a cut may fall into is split by
#: so many further bits.
FIRST_BITS, MORE_BITS = 16, 8
#: Bytes that a row has besides its text.
ROW_BYTES = 8


def greedy_cuts(ends: np.ndarray, shards: int, capacity: int) -> np.ndarray | None:
    """First groups of shards 1 to shards - 1, each shard filled as far as capacity goes; None if the groups need more shards."""
    cuts, base = [], 0
    for _ in range(shards):
        stop = int(np.searchsorted(ends, base + capacity, "right"))
        if stop == len(ends):
            return np.array(cuts + [stop] * (shards - 1 - len(cuts)), np.int64)
        cuts.append(stop)
        base = int(ends[stop - 1]) if stop else 0
    return None


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[np.ndarray, int]:
    """The cuts and the smallest capacity under which contiguous shards hold all groups.

    The capacity is found by binary search with the greedy check.  Of the cuts that meet it, the ones nearest to even
    shares are taken, so that the last shards aren't left with the rest.
    """
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return np.zeros(shards - 1, np.int64), 0
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    low, high = max(int(sizes.max()), -(-total // shards)), total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy_cuts(ends, shards, mid) is not None else (mid + 1, high)
    starts = np.concatenate(([0], ends))
    latest = greedy_cuts(ends, shards, low)
    # The earliest cuts come from the same greedy fill from the right.
    back = greedy_cuts(np.cumsum(sizes[::-1]), shards, low)
    earliest = len(sizes) - back[::-1]
    cuts, at = [], 0
    for i in range(shards - 1):
        reach = int(np.searchsorted(ends, starts[at] + low, "right"))
        want = int(np.argmin(np.abs(starts[earliest[i] : latest[i] + 1] - total * (i + 1) / shards))) + int(earliest[i]) if latest[i] >= earliest[i] else int(latest[i])
        at = max(at, min(max(want, int(earliest[i])), reach, int(latest[i])))
        cuts.append(at)
    return np.array(cuts, np.int64), low


def _reach(ends: np.ndarray, atomic: np.ndarray, shards: int, capacity: int) -> list[int]:
    """How far shards 1 to shards - 1 can reach if each holds ``capacity``, and cells that aren't atomic can be cut anywhere."""
    out, at = [], 0
    for _ in range(shards - 1):
        at = min(at + capacity, int(ends[-1]))
        cell = int(np.searchsorted(ends, at, "right"))
        if cell < len(ends) and atomic[cell]:
            at = int(ends[cell - 1]) if cell else 0
        out.append(at)
    return out


def cells_to_split(sizes: np.ndarray, atomic: np.ndarray, shards: int) -> np.ndarray:
    """The cells of several groups whose inner cuts could lower the capacity; none, if the cuts of the cells are the best of all.

    With the capacity of the cells or less, a cut can't lie beyond what the shards before it can reach, nor before what the
    shards after it must leave.
    """
    _, capacity = minimax_cuts(sizes, shards)
    total = int(sizes.sum())
    least = max(-(-total // shards), int(sizes[atomic].max(initial=0)))
    if capacity <= least:
        return np.zeros(0, np.int64)
    large = np.flatnonzero(~atomic & (sizes > least))
    if len(large):  # fewer than the shards
        return large
    ends = np.cumsum(sizes)
    latest = _reach(ends, atomic, shards, capacity)
    back = _reach(np.cumsum(sizes[::-1]), atomic[::-1], shards, capacity)
    hit = np.zeros(len(sizes), bool)
    for high, left in zip(latest, back[::-1]):
        low = total - left
        hit[int(np.searchsorted(ends, min(low, high), "right")) : int(np.searchsorted(ends, max(low, high), "left")) + 1] = True
    return np.flatnonzero(hit & ~atomic)


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into a shard so that equal texts stay together and the largest shard is as small as can be.

    The groups of equal texts stand in the order of a 64-bit hash.  The sizes of ranges of it, at first 2^FIRST_BITS, go to the driver; those
    that hold several groups and into which a cut of the best partition could fall are split by MORE_BITS more bits, until
    there are none: the cuts by :func:`minimax_cuts` are then those of the groups themselves.  Rows are range-sorted by hash and id, written,
    and numbered by their places in the files, so no task holds a hot group.

    Returns ``id_col, size, text_crc32, shard, slot``.  Null texts count as empty.  Texts of one hash are one group.  Rows with
    equal or null ids each get a slot of their own.  An empty table gives an empty result; extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = ["h", "id", "size", "crc"]
    rows = docs.select(F.xxhash64(text).alias("h"), F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    paths: list[str] = []
    rows = written(rows, "shard-rows", paths)
    ordered = written(rows.repartitionByRange(*names).sortWithinPartitions(*names), "shard-order")
    firsts = _cut_hashes(rows, shards)
    dropped(docs.sparkSession, paths)
    cuts = F.array(*(F.lit(x) for x in firsts)) if firsts else F.array().cast("array<bigint>")
    placed = in_written_order(ordered, "place").withColumn("shard", F.size(F.filter(cuts, lambda c: c <= F.col("h"))))
    starts = placed.groupBy("shard").agg(F.min("place").alias("start"))  # a row for each shard
    out = placed.join(F.broadcast(starts), "shard")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") - F.col("start")).alias("slot"))


def _cut_hashes(rows: DataFrame, shards: int) -> list[int]:
    """The first hash of each shard but the first one."""
    sums = (F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"))
    bits = FIRST_BITS
    cells = rows.groupBy(F.shiftright("h", 64 - bits).alias("cell")).agg(*sums).select("low", "high", "size").toPandas()  # 2^FIRST_BITS rows at most
    while True:
        cells = cells.sort_values("low", ignore_index=True)
        size, low, high = (cells[c].to_numpy(np.int64) for c in ("size", "low", "high"))
        split = cells_to_split(size, low == high, shards) if len(cells) else []
        if not len(split):
            break
        bits = min(64, bits + MORE_BITS)
        # The cells to split are few and lie in at most as many ranges as there are cuts or large cells.
        runs = np.split(split, np.flatnonzero(np.diff(split) > 1) + 1)
        inside = reduce(or_, (F.col("h").between(int(low[r[0]]), int(high[r[-1]])) for r in runs))
        parts = rows.where(inside).groupBy(F.shiftright("h", 64 - bits).alias("cell")).agg(*sums).select("low", "high", "size").toPandas()
        stay = np.ones(len(cells), bool)
        for r in runs:
            stay[r[0] : r[-1] + 1] = False
        cells = pd.concat([cells[stay], parts])
    cuts, _ = minimax_cuts(size, shards) if len(cells) else (np.zeros(shards - 1, np.int64), 0)
    return [int(low[c]) if c < len(low) else 2**63 - 1 for c in cuts]
