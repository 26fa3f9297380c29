"""Distance joins as equi-joins on grid cells, and interval joins."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..store import once
from .dbscan import repeated
from .groups import grouped


def near_pairs(points: DataFrame, eps: float, key: str = "time", geographic: bool = False) -> DataFrame:
    """``key, a, b`` with a < b for points of one key at most eps apart.

    Each point meets the points of its own and the neighbouring cells of width eps (of at least that many meters if
    geographic); a half of the neighbours is enough, so every pair meets once.
    """
    points = points.select(key, "id", "x", "y").where("x is not null and y is not null")
    if geographic:
        return _near_on_globe(points, eps, key)
    cells = points.withColumns({"cx": F.floor(F.col("x") / eps), "cy": F.floor(F.col("y") / eps)})
    half = [(0, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in half))
    left = cells.select(key, F.col("id").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", F.explode(steps).alias("s"))
    moved = ((F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy"))
    left = left.select(key, "i", "ax", "ay", *moved, ((F.col("s.dx") == 0) & (F.col("s.dy") == 0)).alias("own"))
    joined = left.join(cells.select(key, F.col("id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy"), [key, "cx", "cy"])
    met = F.when(F.col("own"), F.col("i") < F.col("j")).otherwise(F.col("i") != F.col("j"))
    return joined.where(met & (geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= eps)).select(key, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))


def _near_on_globe(points: DataFrame, eps: float, key: str) -> DataFrame:
    """Cells of bands of latitude: a band has as many cells around as keep them at least as wide as eps is in it and its neighbours.

    Cells wrap at 180 degrees; a band at a pole has one cell.
    """
    lat_step = eps / (math.pi * geo.EARTH_M / 180) * 1.000001

    def around(row):
        far = F.greatest(F.abs((row - 1) * lat_step), F.abs((row + 2) * lat_step))
        ratio = F.lit(math.sin(min(eps / 2 / geo.EARTH_M, math.pi / 2)) * 1.000001) / F.cos(F.radians(far))
        return F.when((far >= 90) | (ratio >= 1), F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(math.pi / F.asin(F.least(ratio, F.lit(1.0)))))).cast("long")

    def cell(n):
        return F.pmod(F.floor((F.col("x") + 180) / 360 * n), n)

    points = points.withColumn("cy", F.floor(F.col("y") / lat_step))
    right = points.select(F.col(key), F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cy", cell(around(F.col("cy"))).alias("cx"))
    left = points.withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1))).withColumn("n", around(F.col("cy")))
    beside = F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(cell(F.col("n")) + d, F.col("n"))))
    left = left.select(F.col(key), F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cy", F.explode(beside).alias("cx"))
    met = left.join(right, [key, "cy", "cx"]).where(F.col("a") < F.col("b"))
    return met.where(geo.haversine(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= eps).select(key, "a", "b")


def assign_windows(segs: DataFrame, windows: DataFrame) -> DataFrame:
    """Segments with each window that they meet.

    Both are dealt to slots of the mean length of a window and joined by slot; of the slots that they share only the first joins them.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = windows.agg(F.min(micros("p_start")).alias("__from"), F.greatest(F.lit(1), F.ceil((F.max(micros("p_end")) - F.min(micros("p_start"))) / F.greatest(F.count(F.lit(1)), F.lit(1)))).cast("long").alias("__step"), F.max(micros("p_end")).alias("__to"))

    def dealt(df, start, end, first):
        df = df.join(F.broadcast(span))  # one row
        slot = lambda c: F.floor((F.least(F.greatest(micros(c), F.col("__from")), F.col("__to")) - F.col("__from")) / F.col("__step"))
        return df.withColumn(first, slot(start)).withColumn("__slot", F.explode(F.sequence(F.col(first), slot(end)))).drop("__from", "__step", "__to")

    met = dealt(segs.where("t0 <= t1"), "t0", "t1", "__first_s").join(dealt(windows, "p_start", "p_end", "__first_w"), "__slot")
    meet = (F.col("t1") >= F.col("p_start")) & (F.col("t0") <= F.col("p_end")) & (F.col("__slot") == F.greatest("__first_s", "__first_w"))
    return met.where(meet).select(*segs.columns, *windows.columns)


#: Segments, or objects, of a block: a window of more is cut into FEW blocks, and into more only if they would be larger than MOST.
BLOCK, FEW, MOST = 1_024, 4, 1 << 17
#: Blocks lie side by side within strips of so many cells.
STRIP = 16
#: Pairs that are measured, or returned, at once.
CHUNK = 1 << 20
#: Rows and columns of a tile, whose single-precision matrices fit a core's cache.
TILE = (64, 1_024)
#: Times at which two objects are first compared.
LOOKS = 4
_BOX = ("x0", "y0", "x1", "y1")


def _to_segment(px, py, ax, ay, bx, by) -> np.ndarray:
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.clip(((px - ax) * dx + (py - ay) * dy) / size, 0.0, 1.0)
    t = np.where(size == 0, 0.0, t)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return np.sqrt(ex * ex + ey * ey)


def segment_gap(a: list[np.ndarray], b: list[np.ndarray], crossing: bool = True) -> np.ndarray:
    """Distances of segments, as arrays of x0, y0, x1, y1; with ``crossing`` 0 where they cross or touch."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, b
    least = np.minimum.reduce((_to_segment(ax, ay, cx, cy, dx, dy), _to_segment(bx, by, cx, cy, dx, dy), _to_segment(cx, cy, ax, ay, bx, by), _to_segment(dx, dy, ax, ay, bx, by)))
    if not crossing:
        return least
    turn = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)

    def on(px, py, qx, qy, rx, ry):
        return (rx >= np.minimum(px, qx) - geo.TINY) & (rx <= np.maximum(px, qx) + geo.TINY) & (ry >= np.minimum(py, qy) - geo.TINY) & (ry <= np.maximum(py, qy) + geo.TINY)

    o = turn(ax, ay, bx, by, cx, cy), turn(ax, ay, bx, by, dx, dy), turn(cx, cy, dx, dy, ax, ay), turn(cx, cy, dx, dy, bx, by)
    touch = on(ax, ay, bx, by, cx, cy), on(ax, ay, bx, by, dx, dy), on(cx, cy, dx, dy, ax, ay), on(cx, cy, dx, dy, bx, by)
    zero = (o[0] * o[1] < 0) & (o[2] * o[3] < 0)
    for turned, lies in zip(o, touch):
        zero |= (np.abs(turned) < geo.TINY) & lies
    return np.where(zero, 0.0, least)


def end_gap(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The least distance of an end of one segment to an end of the other."""
    far = lambda i, j: np.sqrt((a[i] - b[j]) ** 2 + (a[i + 1] - b[j + 1]) ** 2)
    return np.minimum.reduce([far(i, j) for i in (0, 2) for j in (0, 2)])


#: The distances that segments can be joined by.
SEGMENT_DISTANCES = {"ends": end_gap, "clamped": partial(segment_gap, crossing=False), "exact": segment_gap}


def cell_blocks(parts: DataFrame, own: str, eps: float, cell: float, block: int):
    """Segments grouped by window, grid cell and pair of blocks.

    Boxes, grown by half of eps and the tolerance, are dealt to cells, and a cell's segments to blocks of about ``block`` by a hash.
    """
    pad = F.col("tolerance") + eps / 2
    floor = lambda v: F.floor(v / cell)
    low = {"fx": floor(F.least("x0", "x1") - pad), "fy": floor(F.least("y0", "y1") - pad), "lx": floor(F.greatest("x0", "x1") + pad), "ly": floor(F.greatest("y0", "y1") + pad)}
    rows = parts.select("p", F.col(own).cast("long").alias("id"), "t0", "t1", *_BOX, "tolerance").withColumns(low)
    rows = rows.withColumn("cx", F.explode(F.sequence("fx", "lx"))).withColumn("cy", F.explode(F.sequence("fy", "ly"))).drop("lx", "ly")
    counts = rows.groupBy("p", "cx", "cy").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = rows.join(counts, ["p", "cx", "cy"]).withColumn("own", F.pmod(F.xxhash64("id", "t0"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    return grouped(rows.drop("blocks", "own", "other"), "p", "cx", "cy", "lo", "hi")


def block_pairs(parts: DataFrame, own: str, eps: float, cell: float, temporal: bool = True):
    """Segments grouped by window and pair of blocks; without their times if not ``temporal``.

    The ``own`` ids of a window, by strip and place, are cut into blocks of equal numbers.  Pairs of blocks whose boxes, grown by
    half of eps and the tolerance, lie apart are left out.  Any two ids are in one group alone, and a segment is sent once for each
    pair that its block is in: FEW times, up to FEW * MOST ids, and not in proportion to its window.
    """
    times = ("t0", "t1") if temporal else ()
    rows = parts.select("p", F.col(own).cast("long").alias("id"), *times, *_BOX, "tolerance").dropna(subset=["p", "id", *_BOX, "tolerance"])
    middle = [(F.avg(F.col(f"{c}0") + F.col(f"{c}1")).over(Window.partitionBy("p", "id")) / 2).alias(f"m{c}") for c in "xy"]
    rows = rows.select("*", *middle).withColumn("nth", F.dense_rank().over(Window.partitionBy("p").orderBy(F.floor(F.col("mx") / (STRIP * cell)), "my", "id")) - 1)
    n = F.max("nth").over(Window.partitionBy("p")) + 1
    count = F.greatest(F.least(F.ceil(n / BLOCK), F.lit(FEW)), F.ceil(n / MOST))
    rows = once(rows.withColumn("block", F.floor(F.col("nth") * count / n).cast("int")).drop("mx", "my", "nth"))
    pad = (F.col("tolerance") + eps / 2) * 1.000001  # more than rounding
    box = {"lx": F.min(F.least("x0", "x1") - pad), "ly": F.min(F.least("y0", "y1") - pad), "hx": F.max(F.greatest("x0", "x1") + pad), "hy": F.max(F.greatest("y0", "y1") + pad)}
    lo = rows.groupBy("p", "block").agg(*(v.alias(c) for c, v in box.items()))
    hi = lo.select("p", F.col("block").alias("other"), *(F.col(c).alias(f"o{c}") for c in box))
    met = lo.join(hi, "p").where("block <= other and lx <= ohx and olx <= hx and ly <= ohy and oly <= hy")
    ends = F.array(F.struct("block", F.lit(0).alias("side")), F.struct(F.col("other").alias("block"), F.lit(1).alias("side")))
    sides = met.select("p", F.col("block").alias("lo"), F.col("other").alias("hi"), F.explode(ends).alias("e")).where("lo < hi or e.side = 0")
    return grouped(rows.join(sides.select("p", "lo", "hi", "e.*"), ["p", "block"]).drop("block"), "p", "lo", "hi")


def _ranks(*values: np.ndarray) -> list[np.ndarray]:
    """Small whole numbers of the same order."""
    known, rank = np.unique(np.concatenate(values), return_inverse=True)
    return np.split(rank.astype(np.int16 if len(known) < 1 << 15 else np.int32), np.cumsum([len(v) for v in values])[:-1])


class _Tiles:
    """Two sets of boxes, or one against itself, as tiles of pairs that may be near: what cheap matrices can't decide is measured.

    ``low`` and ``high`` are the boxes' sides by axis, ``spare`` what each adds to ``eps``, ``cells`` ranks of the boxes' first and last
    cells by axis.  ``points`` are sets of points (x, y, spare), one of each item: two items are near if two points of
    a set are, so that single precision, with a margin for its rounding, decides most pairs; ``close`` decides the rest exactly.
    """

    def __init__(self, left, right, two: bool, low, high, spare, eps: float, points, close, cells=None, times=None, all_points: bool = False):
        self.two, self.close, self.all_points = two, close, all_points
        # By the axis on which boxes are least wide for what they cover, so that a tile meets a range of the others alone.
        wide = [max(float((hi[right] - lo[right]).max(initial=0)), 1e-300) for lo, hi in zip(low, high)]
        axis = int(np.argmax([np.ptp(lo[right]) / w if len(right) else 0 for lo, w in zip(low, wide)]))
        by_place = lambda at: at[np.argsort(low[axis][at], kind="stable")]
        self.right = by_place(right)
        self.left = by_place(left) if two else self.right
        self.axis, self.wide, self.low, self.high, self.spare = axis, wide[axis], low, high, spare
        self.reach = (eps + spare[left].max(initial=0) + spare[right].max(initial=0)) * 1.000001
        centre = [float(np.median(v)) if len(v) else 0.0 for v in low]
        span = max([eps, 0.0, *(float(np.abs(v - c).max(initial=0)) for lo, hi, c in zip(low, high, centre) for v in (lo, hi))])
        unit = self.reach if 0 < self.reach < np.inf else 1.0  # so that squares of what is near neither overflow nor vanish
        with np.errstate(all="ignore"):
            single = lambda v, c=0.0: ((v - c) / unit).astype(np.float32)
            self.eps, self.margin = np.float32(eps / unit), np.float32(2e-6 * (span + self.reach) / unit)
            self.lo, self.hi = [single(v, c) for v, c in zip(low, centre)], [single(v, c) for v, c in zip(high, centre)]
            self.more = single(spare)
            self.points = [((single(ax, centre[0]), single(ay, centre[1]), single(at)), (single(bx, centre[0]), single(by, centre[1]), single(bt))) for (ax, ay, at), (bx, by, bt) in points]
        self.cells, self.times = cells, times
        self.memory = [np.empty(TILE[0] * TILE[1], np.float32) for _ in range(3)] + [np.empty(TILE[0] * TILE[1], bool) for _ in range(3)]

    def __iter__(self):
        """``rows, columns, near``: places of a tile's items, and which of them are near each other."""
        left, right, axis = self.left, self.right, self.axis
        ordered, top = self.low[axis][right], [v[right] for v in self.high]
        bottom = [v[right] for v in self.low]
        for s in range(0, len(left), TILE[0]):
            rows = left[s : s + TILE[0]]
            low, high = [v[rows].min() for v in self.low], [v[rows].max() for v in self.high]
            if self.cells:
                at = np.arange(s if not self.two else 0, len(right))
            else:
                first = np.searchsorted(ordered, low[axis] - self.reach - self.wide * 1.000001) if self.two else s
                at = np.arange(first, np.searchsorted(ordered, high[axis] + self.reach, "right"))
                for lo, hi, b, t in zip(low, high, bottom, top):
                    at = at[~((b[at] > hi + self.reach) | (t[at] < lo - self.reach))]
            for c in range(0, len(at), TILE[1]):
                own = at[c : c + TILE[1]]
                near = self._near(rows, right[own], None if self.two or own[0] >= s + len(rows) else own[None, :] > np.arange(s, s + len(rows))[:, None])
                if near is not None:
                    yield rows, right[own], near

    def _near(self, i: np.ndarray, j: np.ndarray, ok):
        shape = len(i), len(j)
        d, e, most, near, far, one = (m[: shape[0] * shape[1]].reshape(shape) for m in self.memory)
        if self.times is not None:
            t0, t1 = self.times
            np.less_equal(t0[i][:, None], t1[j], out=far)
            np.greater_equal(t1[i][:, None], t0[j], out=one)
            far &= one
            ok = far.copy() if ok is None else ok & far
        near.fill(False)
        eps, least = self.eps, None
        same = not self.more[i].any() and not self.more[j].any()
        with np.errstate(all="ignore"):
            for (ax, ay, at), (bx, by, bt) in self.points:
                np.subtract(ax[i][:, None], bx[j], out=d)
                np.multiply(d, d, out=d)
                np.subtract(ay[i][:, None], by[j], out=e)
                np.multiply(e, e, out=e)
                d += e
                if same:
                    least, d, e = (d, most, e) if least is None else (np.minimum(least, d, out=least), d, e)
                elif eps > self.margin:
                    np.add(at[i][:, None], bt[j] + (eps - self.margin), out=e)
                    np.multiply(e, e, out=e)
                    np.less_equal(d, e, out=one)
                    near |= one
            if same and eps > self.margin:
                np.less_equal(least, (eps - self.margin) ** 2, out=near)
            if self.cells:
                far.fill(False)
                for lo, hi in self.cells:
                    far |= lo[i][:, None] > hi[j]
                    far |= lo[j] > hi[i][:, None]
            elif same and self.all_points:
                np.greater(least, (eps + self.margin) ** 2, out=far)
            else:
                limit = eps + self.margin if same else np.add(self.more[i][:, None], self.more[j] + (eps + self.margin), out=most)
                far.fill(False)
                for lo, hi in zip(self.lo, self.hi):
                    np.subtract(lo[i][:, None], hi[j], out=d)
                    np.subtract(lo[j], hi[i][:, None], out=e)
                    np.maximum(d, e, out=d)
                    np.greater(d, limit, out=one)
                    far |= one
        if ok is not None:
            near &= ok
        far |= near
        np.logical_not(far, out=far)
        if ok is not None:
            far &= ok
        a, b = np.nonzero(far)
        if len(a):
            close = self.close(i[a], j[b])
            near[a[close], b[close]] = True
        return near if near.any() else None


def _cell_ranks(low, high, tolerance, cells):
    """For each axis, ranks of the first and the last cell of the boxes grown by half of eps and the tolerance."""
    pad = tolerance + cells[0] / 2
    return [_ranks(np.floor((lo - pad) / cells[1]), np.floor((hi + pad) / cells[1])) for lo, hi in zip(low, high)]


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side != 0)
    return (left, right, True) if len(right) else (left, left, False)


def _segment_tiles(col: dict, limit, distance, temporal: bool, cells: tuple[float, float] | None = None) -> _Tiles:
    """Of the segments of one or two blocks, those that lie near each other: first by time, their ends and boxes, or cells, then by distance."""
    low = [np.minimum(col[f"{k}0"], col[f"{k}1"]) for k in "xy"]
    high = [np.maximum(col[f"{k}0"], col[f"{k}1"]) for k in "xy"]
    tolerance = col["tolerance"]
    ends = [(col[f"x{k}"], col[f"y{k}"], tolerance) for k in (0, 1)]
    points = [(a, b) for a in ends for b in ends]
    if distance is segment_gap:  # of those that cross, middles may be nearer than any end
        middle = (col["x0"] + col["x1"]) / 2, (col["y0"] + col["y1"]) / 2, tolerance
        points.append((middle, middle))

    def close(i, j):
        return distance([col[c][i] for c in _BOX], [col[c][j] for c in _BOX]) <= limit(tolerance[i], tolerance[j])

    in_cells = _cell_ranks(low, high, tolerance, cells) if cells else None
    times = _ranks(col["t0"], col["t1"]) if temporal else None
    return _Tiles(*_sides(col["side"]), low, high, tolerance, float(limit(0.0, 0.0)), points, close, in_cells, times, distance is end_gap)


def _held_against(col: dict, limit, distance, temporal: bool, cells: tuple[float, float] | None):
    """Segments of different ids that lie near each other: arrays (places, places), of one block the smaller id first.

    ``limit`` gives the most distance from both tolerances; with ``cells``, eps and the side of a cell, boxes must share a cell.
    """
    tiles = _segment_tiles(col, limit, distance, temporal, cells)
    for rows, columns, near in tiles:
        a, b = np.nonzero(near)
        i, j = rows[a], columns[b]
        apart = col["id"][i] != col["id"][j]
        i, j = i[apart], j[apart]
        turned = (col["id"][i] > col["id"][j]) & (not tiles.two)
        yield np.where(turned, j, i), np.where(turned, i, j)


def _object_tiles(col: dict, eps: float, cells: tuple[float, float] | None) -> tuple[np.ndarray, _Tiles]:
    """The objects of one or two blocks, and those of them that have segments at the same time whose lower bound is at most eps.

    First come the places of both at some times, on segments that then meet in time, and the boxes of all segments of an object.
    """
    order = np.lexsort((col["t0"], col["id"]))
    col = {c: v[order] for c, v in col.items()}
    first = np.flatnonzero(np.append(True, col["id"][1:] != col["id"][:-1]))
    counts = np.diff(np.append(first, len(order)))
    of = np.repeat(np.arange(len(first)), counts)
    low = [np.minimum(col[f"{k}0"], col[f"{k}1"]) for k in "xy"]
    high = [np.maximum(col[f"{k}0"], col[f"{k}1"]) for k in "xy"]
    t0, t1, tolerance = col["t0"], col["t1"], col["tolerance"]
    looks = np.unique(np.quantile(np.concatenate((t0, t1)), [0.1, 0.4, 0.6, 0.9], method="nearest"))
    if len(looks) < LOOKS:
        looks = np.unique(np.concatenate((looks, looks[:-1] + (looks[1:] - looks[:-1]) // 2)))
    points = []
    for t in looks[:LOOKS]:
        at = np.flatnonzero((t0 <= t) & (t <= t1))
        part = (t - t0[at]) / np.maximum(t1[at] - t0[at], 1)
        sides = []
        for away in (np.inf, -np.inf):  # objects without a place then are near none
            x, y, spare = np.full(len(first), away), np.full(len(first), away), np.zeros(len(first))
            x[of[at]], y[of[at]], spare[of[at]] = col["x0"][at] + part * (col["x1"][at] - col["x0"][at]), col["y0"][at] + part * (col["y1"][at] - col["y0"][at]), tolerance[at]
            sides.append((x, y, spare))
        points.append(tuple(sides))
    in_cells = _cell_ranks(low, high, tolerance, cells) if cells else None

    def close(i, j):
        found = np.zeros(len(i), bool)
        ends = np.cumsum(counts[i] * counts[j])
        s = 0
        while s < len(i):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + CHUNK // 4, "right")))
            n = counts[i[s:e]] * counts[j[s:e]]
            pair = np.repeat(np.arange(s, e), n)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            a, b = first[i[pair]] + nth // counts[j[pair]], first[j[pair]] + nth % counts[j[pair]]
            ok = (t0[a] <= t1[b]) & (t1[a] >= t0[b])
            if in_cells:
                for lo, hi in in_cells:
                    ok &= (lo[a] <= hi[b]) & (lo[b] <= hi[a])
            else:
                reach = eps + tolerance[a] + tolerance[b]
                reach = reach * 1.000001
                for lo, hi in zip(low, high):
                    ok &= ~(np.maximum(lo[a] - hi[b], lo[b] - hi[a]) > reach)
            a, b, pair = a[ok], b[ok], pair[ok]
            near = segment_gap([col[c][a] for c in _BOX], [col[c][b] for c in _BOX]) <= eps + tolerance[a] + tolerance[b]
            found[pair[near]] = True
            s = e
        return found

    whole = lambda f, values: [f.reduceat(v, first) for v in values]
    boxes = [(np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)) for lo, hi in in_cells] if cells else None
    return col["id"][first], _Tiles(*_sides(col["side"][first]), whole(np.minimum, low), whole(np.maximum, high), np.maximum.reduceat(tolerance, first), eps, points, close, boxes)


def _columns(batches) -> tuple[pa.Table, dict]:
    """A group as a table and as arrays; times as numbers."""
    table = pa.Table.from_batches(list(batches))
    col = {c: table.column(c).to_numpy() for c in ("id", *_BOX, "tolerance", "side")}
    return table, col | {c: table.column(c).cast(pa.int64()).to_numpy() for c in ("t0", "t1") if c in table.column_names}


def _lists(table: pa.Table, ids: np.ndarray, tiles: _Tiles) -> Iterator[pa.RecordBatch]:
    """``p, one, others``: an id and near ones of it, many a row, so that no row is sent for each pair."""
    held, size = [], 0

    def batch():
        one, counts, others = (np.concatenate([h[k] for h in held]) for k in range(3))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(others))
        return pa.RecordBatch.from_arrays([repeated(table, "p", len(one)), pa.array(one), lists], ["p", "one", "others"])

    for rows, columns, near in tiles:
        counts = np.count_nonzero(near, axis=1)
        some = counts > 0
        held.append((ids[rows[some]], counts[some], np.broadcast_to(ids[columns], near.shape)[near]))
        size += len(held[-1][2])
        if size >= CHUNK:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _by_row(lists: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lists:
        own = batch.column("others")
        one, other = (v.to_numpy(zero_copy_only=False) for v in (batch.column("one").take(own.value_parent_indices()), own.flatten()))
        yield pa.RecordBatch.from_arrays([batch.column("p").take(own.value_parent_indices()), pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], ["p", "a", "b"])


def spread(lists: DataFrame) -> DataFrame:
    """``p, a, b`` with a < b, a row for each pair of ``p, one, others``."""
    pairs = lists.select("p", "one", F.explode("others").alias("other"))
    return pairs.select("p", F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"))


def _returned(groups, parts: DataFrame, run, lists: bool) -> DataFrame:
    p = dict(parts.dtypes)["p"]
    if lists:
        return groups.applyInArrow(run, f"p {p}, one long, others array<long>")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_row(run(batches))

    return groups.applyInArrow(rows, f"p {p}, a long, b long")


def trajectory_pairs(parts: DataFrame, eps: float, cell: float, lemma: bool = True, lists: bool = False) -> DataFrame:
    """``p, a, b``: objects with segments at the same time whose lower bound is at most eps; with ``lists`` for :func:`spread`.

    Blocks of objects are held against each other in tiles; the gap of boxes (``lemma``) can't lose a pair; without it
    boxes must share a grid cell.  An object's segments of a window are in one block, so no pair comes twice, and no pair is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, col = _columns(batches)
        yield from _lists(table, *_object_tiles(col, eps, None if lemma else (eps, cell)))

    return _returned(block_pairs(parts, "id", eps, cell), parts, run, lists)


def numbered_segments(parts: DataFrame) -> DataFrame:
    """``parts`` with ``seg``, the segment's number in its window by object and time."""
    return parts.withColumn("seg", F.row_number().over(Window.partitionBy("p").orderBy("id", "t0")).cast("long"))


def segment_pairs(parts: DataFrame, eps: float, cell: float, distance: str = "ends", temporal: bool = False, lists: bool = False) -> DataFrame:
    """``p, a, b`` with a < b: numbered segments of one window, also of one object, at most eps and both tolerances apart.

    Blocks are those of :func:`block_pairs`; pairs are returned as they are found, and none comes twice.  ``temporal`` asks for a common
    time as well; ``lists`` is for :func:`spread`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, col = _columns(batches)
        yield from _lists(table, col["id"], _segment_tiles(col, lambda x, y: eps + x + y, SEGMENT_DISTANCES[distance], temporal))

    return _returned(block_pairs(parts, "seg", eps, cell, temporal), parts, run, lists)
