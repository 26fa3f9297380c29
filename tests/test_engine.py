"""The trajectory engine against hand-computed cases, brute force and the registered SQL."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayfold import queries as Q
from wayfold.functions import geo
from wayfold.functions.values import object_ids, round_time
from wayfold.operators import joins, preprocess, recurrence, simplify, tracker, windows
from wayfold.operators.dbscan import clusters
from wayfold.operators.dense import link_clusters, point_clusters, point_links, segment_links
from wayfold.operators.joins import assign_windows, near_pairs, numbered_segments, segment_pairs, trajectory_pairs
from wayfold.operators.tracker import fold
from wayfold.plans import convoys
from wayfold.sources import points as sources

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lits(*values):
    return [F.lit(float(v)) for v in values]


@pytest.mark.parametrize("args,want", [((5, 5, 0, 0, 10, 10), 0), ((5, 10, 0, 0, 10, 0), 10), ((-3, 4, 0, 0, 10, 0), 5), ((3, 4, 0, 0, 0, 0), 5)])
def test_point_segment(spark, args, want):
    assert value(spark, geo.point_segment(*lits(*args))) == pytest.approx(want)


@pytest.mark.parametrize("args,meets,far", [((0, 0, 10, 10, 0, 10, 10, 0), True, 0), ((0, 0, 10, 10, 0, 15, 10, 15), False, 5), ((0, 0, 10, 0, 0, 10, 10, 10), False, 10), ((0, 0, 10, 0, 5, -5, 5, 5), True, 0)])
def test_segments(spark, args, meets, far):
    assert value(spark, geo.segments_intersect(*lits(*args))) is meets
    assert value(spark, geo.segment_segment(*lits(*args))) == pytest.approx(far)


def test_overlap_in_window(spark):
    hours = lambda *h: [F.lit(x) for x in h]
    assert value(spark, geo.overlap_within(*hours(12.0, 14.0, 13.5, 15.0, 13.0, 18.0)))
    assert not value(spark, geo.overlap_within(*hours(13.5, 15.0, 19.0, 20.0, 13.0, 18.0)))


def test_rounding_goes_to_even(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 13, m),) for m in (5, 15, 25, 35)], "t timestamp").select(round_time(F.col("t"), 10).alias("r"))
    assert [r["r"].strftime("%H:%M") for r in rows.collect()] == ["13:00", "13:20", "13:20", "13:40"]


def test_object_ids(spark):
    assert value(spark, object_ids(F.lit("{np.int64(110), 7}"))) == [64, 110, 7]


def test_tracker_cases():
    s = lambda *x: frozenset(x)
    steps = [(1, 1, 1, [s(1, 2, 3, 4), s(7, 8, 9)]), (2, 2, 1, [s(1, 2, 3), s(7, 8, 9)]), (3, 3, 1, [s(1, 2, 3, 5)])]
    assert set(fold(steps, 3, 2, False, False)) == {(s(7, 8, 9), 1, 2, 2), (s(1, 2, 3), 1, 3, 3)}
    grown = [(1, 1, 1, [s(1, 2, 3)]), (2, 2, 1, [s(1, 2, 3, 4)]), (3, 3, 1, [s(1, 2, 3, 4)])]
    assert fold(grown, 3, 2, False, False) == [(s(1, 2, 3), 1, 3, 3)]


@pytest.mark.parametrize("dedupe,block", [(False, 2), (True, 2), (True, 64)])
def test_tracking_by_component_equals_one_fold(spark, monkeypatch, dedupe, block):
    """Two tracks of 30 steps with sets that overlap or are equal, and steps without any: as one fold of each track."""
    monkeypatch.setattr(tracker, "STEPS", block)
    rng, rows, want, active = random.Random(block), [], Counter(), Counter()
    for key in (0, 1):
        steps = []
        for i in range(30):
            places = [] if i % 11 == 7 else [rng.randrange(12) for _ in range(rng.randrange(5))]
            sets = [frozenset(8 * p + o for o in rng.sample(range(11), 7)) for p in places]
            sets += sets[:1] if i % 5 == 0 else []
            steps.append((at(10 * i), at(10 * i + 5), 2, sets))
            rows += [(key, at(10 * i), at(10 * i + 5), 2, sorted(s)) for s in sets] or [(key, at(10 * i), at(10 * i + 5), 2, None)]
        counts = []
        want.update((key, tuple(sorted(o)), s, e, n) for o, s, e, n in fold(steps, 4, 4, dedupe, True, counts))
        active.update({s: n for s, n in counts if n})
    df = spark.createDataFrame(rows, "track int, start timestamp, end timestamp, points int, objects array<long>")
    got = tracker.track(df, 4, 4, dedupe=dedupe, new_needs_m=True).collect()
    assert want and Counter((r["track"], tuple(r["objects"]), r["start_time"], r["end_time"], r["lifetime_points"]) for r in got) == want
    counted = tracker.active_counts(df, 4, 4, dedupe=dedupe, new_needs_m=True).collect()
    assert {r["start"]: r["active_candidates"] for r in counted if r["active_candidates"]} == dict(active)


def test_roots_over_many_blocks(spark, monkeypatch):
    """A chain over 40 steps in blocks of 2 is one component, whatever the round that its links are joined in."""
    monkeypatch.setattr(tracker, "STEPS", 2)
    links = spark.createDataFrame([(0, i, 100 + i, 101 + i) for i in range(40)] + [(0, 3, 7, 9), (1, 3, 103, 9)], "track int, step long, a long, b long")
    nodes = spark.createDataFrame([(0, 100 + i) for i in range(41)] + [(0, 7), (0, 9), (1, 9), (1, 103)], "track int, node long").withColumn("root", F.col("node"))
    for table in tracker.roots(links, "track"):
        nodes = tracker._led(nodes, "root", table, "track")
    got = {(r["track"], r["node"]): r["root"] for r in nodes.collect()}
    assert got == {(0, 100 + i): 100 for i in range(41)} | {(0, 7): 7, (0, 9): 7, (1, 9): 9, (1, 103): 9}


def test_gap_in_time_doesnt_break_a_convoy(spark):
    rows = [(i, at(t), float(i), 0.0) for t in (0, 10, 30) for i in (1, 2, 3)]
    found = convoys.cmc(spark.createDataFrame(rows, "id long, time timestamp, x double, y double"), 3, 3, 2.0).collect()
    assert [(r["objects"], r["lifetime_points"]) for r in found] == [([1, 2, 3], 3)]


def test_lambda_windows(spark):
    for n, size, want in ((28, 4, [(3 * p, min(3 * p + 3, 27)) for p in range(9)]), (6, 4, [(0, 3), (3, 5)])):
        times = spark.createDataFrame([(at(10 * i),) for i in range(n)], "time timestamp")
        got = sorted((int((r["p_start"] - T0).total_seconds()) // 600, int((r["p_end"] - T0).total_seconds()) // 600) for r in windows.lambda_windows(times, size).collect())
        assert got == want


def test_border_point_goes_to_smallest_label(spark):
    pairs = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 3, 5), (0, 5, 7), (0, 7, 8), (0, 7, 9), (0, 8, 9)]
    got = clusters(spark.createDataFrame(pairs, "time int, a long, b long"), 4).collect()
    assert {r["id"]: r["label"] for r in got}[5] == 3


def test_douglas_peucker_ties_and_strictness():
    assert simplify.kept_points(np.array([0.0, 1, 2, 3]), np.array([0.0, 5, 5, 0]), 1.0).tolist() == [True, True, False, True]  # the earlier of two equal points
    assert simplify.kept_points(np.array([0.0, 1, 2]), np.array([0.0, 5, 0]), 5.0).tolist() == [True, False, True]
    assert simplify.kept_points(np.array([0.0, 1, 2]), np.array([0.0, 5, 0]), 4.9).tolist() == [True, True, True]


def test_error_of_simplification_is_bounded():
    rng = np.random.default_rng(3)
    x, y = np.cumsum(rng.normal(size=200)), np.cumsum(rng.normal(size=200))
    keep = np.flatnonzero(simplify.kept_points(x, y, 1.5))
    assert max(simplify._gaps(x, y, i, j, False).max(initial=0) for i, j in zip(keep[:-1], keep[1:])) <= 1.5


def test_stay_points(spark):
    rows = [(1, at(0), 0.0, 0.0), (1, at(2), 10.0, 0.0), (1, at(5), 20.0, 0.0), (1, at(6), 500.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, time timestamp, x double, y double")
    assert [r["x"] for r in preprocess.remove_stay_points(df, 50, 5, planar=True).collect()] == [500.0]


@pytest.mark.parametrize("geographic", [False, True])
def test_near_pairs_equal_all_pairs(spark, geographic):
    rnd = random.Random(5)
    rows = [(i, 0, rnd.uniform(116, 116.01), rnd.uniform(39.9, 39.91)) for i in range(150)] if geographic else [(i, i % 2, rnd.uniform(0, 50), rnd.uniform(-50, 50)) for i in range(150)]
    eps = 120.0 if geographic else 7.0

    def far(a, b):
        return preprocess._meters(a[2], a[3], b[2], b[3]) if geographic else math.hypot(a[2] - b[2], a[3] - b[3])

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and far(a, b) <= eps}
    got = [(r["a"], r["b"]) for r in near_pairs(spark.createDataFrame(rows, "id long, time int, x double, y double"), eps, geographic=geographic).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pruned_pairs_equal_unpruned_and_brute_force(spark):
    pts = Q._points(spark, SF)
    parts = assign_windows(simplify.segments(simplify.simplify(pts, Q.DELTA)), windows.lambda_windows(pts, Q.SIZE)).cache()
    got = [{tuple(r) for r in trajectory_pairs(parts, Q.EPS, Q.CELL, lemma).collect()} for lemma in (True, False)]
    a, b = parts.alias("a"), parts.alias("b")
    names = ("x0", "y0", "x1", "y1")
    far = geo.segment_segment(*(F.col(f"{s}.{c}") for s in "ab" for c in names))
    plain = a.join(b, (F.col("a.p") == F.col("b.p")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.t0") <= F.col("b.t1")) & (F.col("a.t1") >= F.col("b.t0")))
    want = {tuple(r) for r in plain.where(geo.lower_bound(far, F.col("a.tolerance"), F.col("b.tolerance")) <= Q.EPS).select("a.p", "a.id", "b.id").distinct().collect()}
    assert got[0] == got[1] == want


def test_cmc_doesnt_depend_on_partitions(spark):
    pts = Q._points(spark, SF)
    runs = [sorted((tuple(r["objects"]), r["start_time"], r["end_time"]) for r in convoys.cmc(pts.repartition(n), 3, 3, 60.0).collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 2


def walks(seed, objects=14, times=12):
    """Groups that drift together for a while, with gaps."""
    rnd = random.Random(seed)
    home = {i: (i % 4) * 60.0 for i in range(objects)}
    rows = []
    for t in range(times):
        for i in range(objects):
            if rnd.random() < 0.12:
                home[i] = rnd.choice((0.0, 60.0, 120.0, 180.0))
            if rnd.random() < 0.9:
                rows.append((i, at(10 * t), home[i] + rnd.uniform(-9, 9), 15.0 * t + rnd.uniform(-9, 9)))
    return rows


def plain_dbscan(n, near, m):
    """Clusters grown from each core in order; a point stays with the first that reaches it."""
    around = [[j for j in range(n) if j == i or near(min(i, j), max(i, j))] for i in range(n)]
    label = [None] * n
    for i in range(n):
        if label[i] is None and len(around[i]) >= m:
            label[i], todo = i, [i]
            while todo:
                for j in around[todo.pop()]:
                    if label[j] is None:
                        label[j] = i
                        if len(around[j]) >= m:
                            todo.append(j)
    return [[i for i in range(n) if label[i] == c] for c in sorted({x for x in label if x is not None})]


def plain_track(steps, m, k):
    """steps: (start, end, list of sets)."""
    active, done = [], []
    for start, end, found in steps:
        nxt = [(o & c, s, end, n + 1) for o, s, _, n in active for c in found if len(o & c) >= m]
        done += [v for v in active if v[3] >= k and all(len(v[0] & c) < m for c in found)]
        nxt += [(c, start, end, 1) for c in found if all(len(v[0] & c) < m for v in active)]
        active = nxt
    return done + [v for v in active if v[3] >= k]


def plain_cmc(rows, m, k, eps):
    steps = []
    for t in sorted({r[1] for r in rows}):
        now = sorted(r for r in rows if r[1] == t)
        groups = plain_dbscan(len(now), lambda i, j: math.hypot(now[i][2] - now[j][2], now[i][3] - now[j][3]) <= eps, m)
        steps.append((t, t, [frozenset(now[i][0] for i in g) for g in groups]))
    return plain_track(steps, m, k)


def plain_minutes_filter(rows, m, k, eps, delta, minutes):
    segs = []
    for i in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == i), key=lambda r: r[1])
        x, y = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        kept = np.flatnonzero(simplify.kept_points(x, y, delta))
        segs += [(i, own[a][1], own[b][1], own[a][2:], own[b][2:], simplify._gaps(x, y, a, b, False).max(initial=0.0)) for a, b in zip(kept[:-1], kept[1:])]
    steps, start, last = [], min(r[1] for r in rows), max(r[1] for r in rows)
    while start <= last:
        end = start + timedelta(minutes=minutes)
        part = [s for s in segs if s[1] <= end and s[2] >= start]
        near = lambda i, j: min(math.dist(p, q) for p in part[i][3:5] for q in part[j][3:5]) <= eps + part[i][5] + part[j][5]
        steps.append((start, end, [frozenset(part[i][0] for i in g) for g in plain_dbscan(len(part), near, m)]))
        start = end
    return plain_track(steps, m, k)


def convoy_list(df):
    return sorted((tuple(r["objects"]), r["start_time"], r["end_time"], r["lifetime_points"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_minutes_filter_and_refinement_equal_plain_ones(spark, seed):
    rows = walks(seed)
    pts = spark.createDataFrame(rows, sources.POINT).cache()
    exact, candidates = convoys.cuts_minutes(pts, 3, 1, 3, 14.0, 5.0, 30, 50.0)
    want = plain_minutes_filter(rows, 3, 1, 14.0, 5.0, 30)
    assert convoy_list(candidates) == sorted((tuple(sorted(o)), *rest) for o, *rest in want) and want
    refined = [v for o, s, e, _ in want for v in plain_cmc([r for r in rows if r[0] in o and s <= r[1] <= e], 3, 3, 14.0)]
    assert convoy_list(exact) == sorted((tuple(sorted(o)), *rest) for o, *rest in refined) and refined
    once = convoys.refine_by_cmc(pts, candidates, 3, 3, 14.0, dedupe=True)
    assert {v[:3] for v in convoy_list(once)} == {v[:3] for v in convoy_list(exact)} and once.count() == len({v[:3] for v in convoy_list(exact)})


def test_refinement_interpolates_and_equals_plain_one(spark):
    rows = walks(5)
    pts = spark.createDataFrame(rows, sources.POINT).cache()
    spans = [(1, list(range(14)), at(0), at(110), 12), (2, [0, 4, 8, 12, 1], at(20), at(90), 8)]
    cand = spark.createDataFrame(spans, "candidate int, objects array<long>, start_time timestamp, end_time timestamp, lifetime_points int")
    want = set()
    for _, ids, start, end, _ in spans:
        grid = []
        for i in ids:
            own = sorted((r for r in rows if r[0] == i and start <= r[1] <= end), key=lambda r: r[1])
            ts = [(r[1] - T0).total_seconds() for r in own]
            for t in range(int((start - T0).total_seconds()), int((end - T0).total_seconds()) + 1, 600):
                if ts and ts[0] <= t <= ts[-1]:
                    grid.append((i, T0 + timedelta(seconds=t), float(np.interp(t, ts, [r[2] for r in own])), float(np.interp(t, ts, [r[3] for r in own]))))
        steps = []
        for t in sorted({r[1] for r in grid}):
            now = sorted(r for r in grid if r[1] == t)
            groups = plain_dbscan(len(now), lambda a, b: math.hypot(now[a][2] - now[b][2], now[a][3] - now[b][3]) <= 14.0, 3)
            steps.append((t, t, [frozenset(now[a][0] for a in g) for g in groups if len(g) >= 3]))
        want |= {(tuple(sorted(o)), s, e) for o, s, e, _ in plain_track(steps, 3, 3)}
    got = convoy_list(convoys.refine(pts, cand, 3, 3, 14.0))
    assert {v[:3] for v in got} == want and len(got) == len(want) and want


def test_stream_of_points_is_binned(spark, tmp_path):
    from wayfold.streaming.snapshots import binned_stream

    rows = [(1, at(1), 5.0, 5.0), (1, at(0), 4.0, 4.0), (2, at(12), 6.0, 6.0), (9, at(200), 0.0, 0.0)]
    spark.createDataFrame(rows, sources.POINT).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = binned_stream(spark.readStream.schema(sources.POINT).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("binned").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(90)
    assert sorted(tuple(r) for r in spark.table("binned").collect()) == [(1, at(0), 4.0, 4.0), (2, at(10), 6.0, 6.0)]


def test_coverage(spark):
    schema = "objects array<long>, start_time timestamp, end_time timestamp, lifetime_points int"
    exact = spark.createDataFrame([([1, 2, 3], at(0), at(20), 3), ([4, 5, 6], at(0), at(20), 3)], schema)
    cand = spark.createDataFrame([([1, 2, 3, 9], at(10), at(50), 8)], schema)
    assert {tuple(r["objects"]): r["covered"] for r in recurrence.coverage(exact, cand).collect()} == {(1, 2, 3): True, (4, 5, 6): False}


def test_coverage_of_large_convoys(spark):
    rows = [(list(range(n)), at(0), at(9), 3) for n in (2, 15_000)]
    exact = spark.createDataFrame([*rows, ([1, 99_999], at(0), at(9), 3)], "objects array<long>, start_time timestamp, end_time timestamp, lifetime_points int")
    cand = spark.createDataFrame([(list(range(15_000)), at(0), at(5)), ([1, 99_999], at(20), at(30))], "objects array<long>, start_time timestamp, end_time timestamp")
    assert sorted((len(r["objects"]), r["covered"]) for r in recurrence.coverage(exact, cand).collect()) == [(2, False), (2, True), (15_000, True)]


def test_hausdorff_equals_all_distances_and_takes_large_clusters(spark):
    rnd = random.Random(5)
    # Cluster, object, place: object 0 of each cluster has two places.
    rows = [(c, i, 30.0 * c + rnd.gauss(0, 20), rnd.choice([rnd.random() * 40, 7.0])) for c, n in enumerate((1, 5, 70, 300, 500)) for i in [0, *range(n)]]
    members = spark.createDataFrame([(c, at(c), i) for c, i in sorted({(c, i) for c, i, *_ in rows})], "seq long, time timestamp, id long")
    points = spark.createDataFrame([(i, at(c), x, y) for c, i, x, y in rows], sources.POINT)
    pairs = spark.createDataFrame([(a, b) for a in range(5) for b in range(a + 1, 5)], "earlier long, later long")
    got = {(r["earlier"], r["later"]): r["hausdorff"] for r in recurrence.hausdorff(pairs, members, points).collect()}

    def farthest(a, b):
        least = {}
        for c, i, x, y in rows:
            if c == a:
                least[i] = min(least.get(i, math.inf), min(math.hypot(x - u, y - v) for d, _, u, v in rows if d == b))
        return max(least.values())

    assert got.keys() == {(a, b) for a in range(5) for b in range(a + 1, 5)}
    assert all(v == pytest.approx(max(farthest(*k), farthest(*k[::-1])), abs=1e-9) for k, v in got.items())
    crowd = spark.range(2 * 20_000).select((F.col("id") % 2).alias("seq"), (F.col("id") % 2).cast("timestamp").alias("time"), "id")
    places = crowd.select("id", "time", (F.rand(1) * 100).alias("x"), (F.rand(2) * 100).alias("y"))
    assert 0 < recurrence.hausdorff(spark.createDataFrame([(0, 1)], "earlier long, later long"), crowd, places).first()["hausdorff"] < 10  # 400 million distances


def test_csv_round_trip_and_missing_input(spark, tmp_path):
    rows = [(1, at(0), 116.5, 39.9), (2, at(10), 116.6, 39.8)]
    df = spark.createDataFrame(rows, sources.POINT)
    sources.write_points(df, str(tmp_path / "p"))
    assert sorted(tuple(r) for r in sources.read_points(spark, str(tmp_path / "p")).collect()) == rows
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "1.txt").write_text("1,2024-01-01 00:00:00,116.5,39.9\n")
    assert sources.read_raw(spark, str(tmp_path / "raw")).collect()[0]["y"] == 39.9
    with pytest.raises(sources.MissingInput):
        sources.read_points(spark, str(tmp_path / "absent"))
    conv = spark.createDataFrame([([1, 2], at(0), at(10), 2)], "objects array<long>, start_time timestamp, end_time timestamp, lifetime_points int")
    sources.numbered(conv).write.csv(str(tmp_path / "c"), header=True)
    back = sources.read_convoys(spark, str(tmp_path / "c"))
    assert back.collect()[0]["objects"] == [1, 2]
    sources.write_map(sources.routes(df, back), str(tmp_path / "m.html"))
    assert "<svg" in (tmp_path / "m.html").read_text()


def test_map_has_all_routes(spark, tmp_path):
    rows = [(1, i, at(t), float(i), float(t)) for i in range(510) for t in (0, 10)] + [(1, 999, at(0), 5000.0, 0.0)]
    sources.write_map(spark.createDataFrame(rows, "convoy_id int, id long, time timestamp, x double, y double"), str(tmp_path / "m.html"))
    page = (tmp_path / "m.html").read_text()
    assert page.count("<polyline") == 510 and 'points="20.0,580.0 20.0,20.0"' in page and "<script>" in page and page.count("<circle") == 510


def test_poles_and_the_date_line(spark):
    rows = [(1, 0, 0.0, 89.9), (2, 0, 0.2, 89.9), (3, 0, 179.9999, 10.0), (4, 0, -179.9999, 10.0), (5, 0, 10.0, 89.99999), (6, 0, -170.0, 89.99999), (7, 0, 50.0, -89.99999), (8, 0, 0.0, 45.0), (9, 0, 0.001, 45.0)]
    rnd = random.Random(2)
    rows += [(10 + i, 0, rnd.choice((-180.0, 179.9995, rnd.uniform(-180, 180))) + rnd.uniform(0, 0.0005), rnd.choice((89.9995, -89.9993, 60.0)) + rnd.uniform(0, 0.0005)) for i in range(120)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and preprocess._meters(a[2], a[3], b[2], b[3]) <= 60.0}
    got = [(r["a"], r["b"]) for r in near_pairs(spark.createDataFrame(rows, "id long, time int, x double, y double"), 60.0, geographic=True).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {(1, 2), (3, 4), (5, 6)} <= want


def test_a_point_alone_is_a_cluster_of_one(spark):
    rows = [(1, at(0), 0.0, 0.0), (2, at(0), 500.0, 0.0), (3, at(0), 501.0, 0.0)]
    got = convoys.snapshot_members(spark.createDataFrame(rows, sources.POINT), 5.0, 1).collect()
    assert {(r["label"], r["id"]) for r in got} == {(1, 1), (2, 2), (2, 3)}


@pytest.mark.parametrize("geographic", [False, True])
@pytest.mark.parametrize("eps,m,tile", [(5.0, 3, 1), (12.0, 5, 16), (3.0, 2, 2), (7.0, 1, 1), (0.5, 8, 1)])
def test_clusters_by_tiles_equal_those_of_all_pairs(spark, monkeypatch, geographic, eps, m, tile):
    from wayfold.operators import dense

    rnd = random.Random(m)
    # Crowds, wide places, whole numbers for exact distances, and ids that repeat.
    spots = [(i // 2 if i % 9 == 0 else i, rnd.random() * 100 * rnd.choice([1, 1, 2, 20]), rnd.random() * 60) for i in range(300)]
    spots = [(i, float(round(x)), float(round(y))) if i % 3 == 0 else (i, x, y) for i, x, y in spots]
    rows = [(i, at(0), (179.9 + x / 1000 + 180) % 360 - 180, 60 + y / 1000) if geographic else (i, at(0), x, y) for i, x, y in spots]
    pts = spark.createDataFrame(rows, sources.POINT)
    odd = spark.createDataFrame([(900, at(0), float("nan"), 0.0), (901, at(0), float("inf"), 0.0), (902, at(0), None, 0.0)], sources.POINT)
    monkeypatch.setattr(dense, "TILE", tile)
    eps *= 111 if geographic else 1
    want = {tuple(r) for r in clusters(near_pairs(pts, eps, "time", geographic), m).collect()}
    got = point_clusters(pts.unionByName(odd), eps, m, "time", geographic, alone=False).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("block", [7, 1 << 15])
@pytest.mark.parametrize("eps,m,first,cell", [(4.0, 3, 1, 20.0), (9.0, 5, 8, 200.0), (3.0, 2, 2, 50.0), (1.0, 4, 1, 500.0)])
def test_segment_clusters_by_links_equal_those_of_all_pairs(spark, monkeypatch, eps, m, first, cell, block):
    from wayfold.operators import dense

    rnd = random.Random(m)
    rows = [(i, at(60 * t), rnd.choice([20, 60, 300]) * rnd.random() + 5 * t, 40 * rnd.random()) for i in range(60) for t in range(5) if rnd.random() < 0.8]
    pts = spark.createDataFrame(rows, sources.POINT)
    parts = numbered_segments(assign_windows(simplify.segments(simplify.simplify(pts, 4.0)), windows.lambda_windows(pts, 3))).cache()
    monkeypatch.setattr(dense, "FIRST", first)
    monkeypatch.setattr(dense, "BLOCK", block)
    found = lambda df: sorted(tuple(r) for r in df.collect())
    assert found(link_clusters(segment_links(parts, "id", eps, cell, m), m, "p", drop_small=True)) == found(clusters(trajectory_pairs(parts, eps, cell), m, "p", drop_small=True))
    for distance, temporal in (("exact", True), ("ends", False), ("clamped", True)):
        assert found(link_clusters(segment_links(parts, "seg", eps, cell, m, distance, temporal), m, "p")) == found(clusters(segment_pairs(parts, eps, cell, distance, temporal), m, "p"))


def test_crowded_segments_give_few_links(spark):
    rnd = random.Random(1)
    pts = spark.createDataFrame([(i, at(60 * t), rnd.random() * 40, rnd.random() * 40) for i in range(3000) for t in range(2)], sources.POINT)
    parts = assign_windows(simplify.segments(pts), windows.lambda_windows(pts, 2))
    links = segment_links(parts, "id", 60.0, 250.0, 3).collect()
    assert len(links) < 10 * 3000  # 4.5 million pairs
    assert len({r["a"] for r in links}) == 3000


def test_crowds_give_few_links(spark):
    rnd = random.Random(1)
    pts = spark.createDataFrame([(i, at(0), rnd.random() * 100, rnd.random() * 100) for i in range(6000)], sources.POINT).cache()
    assert point_links(pts, 60.0, 3).count() < 4 * 6000  # 12 million near pairs
    assert [tuple(r) for r in convoys.snapshot_members(pts, 60.0, 3).groupBy("label").count().collect()] == [(0, 6000)]


@pytest.mark.parametrize("seed", range(4))
def test_labels_equal_plain_clusters(seed):
    from wayfold.operators.dbscan import labelled

    rnd = random.Random(seed)
    n = 60
    near = {(i, j) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.035}
    a, b = (np.array([p[k] for p in sorted(near)]) for k in (0, 1))
    ids, label = labelled(a, b, 3)
    want = {i: g[0] for g in plain_dbscan(n, lambda i, j: (i, j) in near, 3) for i in g}
    # A cluster's label is its smallest core; a border point goes to the smallest of its clusters, as when clusters grow in order.
    degree = np.bincount(np.concatenate((a, b)), minlength=n) + 1
    groups = {}
    for i, c in want.items():
        groups.setdefault(c, []).append(i)
    want = {i: min(x for x in groups[c] if degree[x] >= 3) for i, c in want.items()}
    assert dict(zip(ids.tolist(), label.tolist())) == want


def test_simplify_leaves_out_nulls_and_repeated_times(spark):
    rows = [(1, at(0), 0.0, 0.0), (1, at(1), 1.0, None), (1, at(2), 2.0, 500.0), (1, at(3), 3.0, 0.0), (1, at(2), 2.0, 100.0), (1, None, 9.0, 9.0)]
    got = simplify.simplify(spark.createDataFrame(rows, sources.POINT), 5.0).orderBy("time").collect()
    assert [(r["x"], r["y"], r["kept"]) for r in got] == [(0.0, 0.0, True), (2.0, 100.0, True), (3.0, 0.0, True)]


def test_windows_need_two_times(spark):
    one = spark.createDataFrame([(at(0),)], "time timestamp")
    assert windows.lambda_windows(one, 4).count() == 0
    with pytest.raises(ValueError):
        windows.lambda_windows(one, 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_assigned_windows_equal_all_pairs(spark, seed):
    rnd = random.Random(seed)
    segs = [(i, at(s := rnd.randint(0, 500)), at(s + rnd.choice((0, 5, 300)))) for i in range(80)]
    wins = [(p, at(10 * p * p), at(10 * p * p + rnd.choice((1, 20, 200)))) for p in range(7)]
    got = assign_windows(spark.createDataFrame(segs, "id long, t0 timestamp, t1 timestamp"), spark.createDataFrame(wins, "p long, p_start timestamp, p_end timestamp")).select("id", "p").collect()
    want = {(i, p) for i, a, b in segs for p, c, d in wins if b >= c and a <= d}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_dense_cells_are_joined_by_blocks(spark, monkeypatch):
    from wayfold.operators import joins

    pts = Q._points(spark, SF)
    parts = assign_windows(simplify.segments(simplify.simplify(pts, Q.DELTA)), windows.lambda_windows(pts, Q.SIZE)).cache()
    want = {tuple(r) for r in trajectory_pairs(parts, Q.EPS, Q.CELL).collect()}
    monkeypatch.setattr(joins, "BLOCK", 3)
    got = trajectory_pairs(parts, Q.EPS, 10 * Q.CELL).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_day_window(spark):
    rows = [(1, at(60 * h), 116.5, 39.9) for h in (9, 13, 15, 18, 20, 40)]
    df = spark.createDataFrame(rows, sources.POINT)
    assert preprocess.day_window(df).count() == 3 and preprocess.day_window(df, "2024-01-02", 15, 2).count() == 1
    with pytest.raises(ValueError):
        preprocess.day_window(df, "2025-05-05")


def test_first_rows_are_those_of_the_file(spark, tmp_path):
    (tmp_path / "log").mkdir()
    for k in (0, 1):
        (tmp_path / "log" / f"{k}.csv").write_text("".join(f"{100 * k + i},2024-01-01 00:0{i % 10}:40,116.5,39.9\n" for i in range(30)))
    got = sources.read_first(spark, str(tmp_path / "log"), 35).collect()
    assert [r["taxi_id"] for r in got] == [*range(30), *range(100, 105)]
    assert got[0]["timestamp"] == at(1) and got[0]["lat_rad"] == pytest.approx(math.radians(39.9))


def test_filter_log_counts_candidates(spark):
    log = convoys.filter_log(spark.createDataFrame(walks(3), sources.POINT), 3, 4, 14.0, 5.0, 4, 50.0).orderBy("p").collect()
    assert len(log) == 4 and all(r["objects_in_partition"] == 14 for r in log) and any(r["active_candidates"] for r in log)


def test_runs_and_maps_by_command_line(spark, tmp_path):
    from wayfold import cli

    rows = [(i, at(13 * 60 + t), 116.4 + i * 1e-4, 39.9 + t * 1e-4) for i in range(4) for t in range(0, 60, 10)] + [(9, at(13 * 60), 117.0, 39.0)]
    sources.write_points(spark.createDataFrame(rows, sources.POINT), str(tmp_path / "p"))
    for method in ("cuts", "cmc"):
        cli.main(["--log", str(tmp_path / "log"), "run", str(tmp_path / "p"), "--output-prefix", str(tmp_path / method), "--method", method, "--start", "13:00", "--delta", "5"])
        found = sources.read_convoys(spark, str(tmp_path / f"{method}-convoys")).collect()
        assert [r["objects"] for r in found] == [[0, 1, 2, 3]] and "<polyline" in (tmp_path / f"{method}-map.html").read_text()
        stages = [r["stage"] for r in spark.read.csv(str(tmp_path / f"{method}-seconds"), header=True).collect()]
        assert stages[0] == "load" and stages[-1] == "map"
    assert "refinement" in (tmp_path / "log").read_text() and spark.read.csv(str(tmp_path / "cuts-filter-log"), header=True).columns[-1] == "active_candidates"
    conv = spark.createDataFrame([([0, 1, 77], at(13 * 60), at(13 * 60 + 20), 3)], "objects array<long>, start_time timestamp, end_time timestamp, lifetime_points int")
    sources.write_convoys(conv, str(tmp_path / "saved"))
    assert cli.show(spark, str(tmp_path / "p"), str(tmp_path / "saved"), str(tmp_path / "saved.html")) == 1
    assert (tmp_path / "saved.html").read_text().count("<polyline") == 2


def test_maps_of_simplified_routes_and_trajectories(spark, tmp_path):
    rows = [(1, at(t), float(t), 0.0) for t in range(5)] + [(2, at(t), float(t), 3.0 * (t % 2)) for t in range(5)]
    pts = spark.createDataFrame(rows, sources.POINT)
    sources.write_simplified_map(pts, simplify.simplify(pts, 1.0), str(tmp_path / "s.html"))
    page = (tmp_path / "s.html").read_text()
    assert page.count("stroke-dasharray") == 2 and page.count("<polyline") == 4 and 'data-layer="simplified 1"' in page
    sources.write_trajectory_map(preprocess.nth_object(pts, 1), str(tmp_path / "t.html"))
    assert (tmp_path / "t.html").read_text().count("<polyline") == 1
    with pytest.raises(IndexError):
        preprocess.nth_object(pts, 2)


@pytest.mark.parametrize("zone", ["Etc/UTC", "America/New_York"])
def test_results_dont_depend_on_the_session_zone(spark, zone):
    names = ("cmc_convoys", "segment_pair_edges_endpoint", "traj_pair_edges", "cuts_convoys", "cuts_filter_log")
    own, counts = spark.conf.get("spark.sql.session.timeZone"), {n: Q.QUERIES[n](spark, SF).count() for n in names}
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        if zone == "Etc/UTC":
            assert {n: Q.QUERIES[n](spark, SF).count() for n in names} == counts
        else:  # days begin at other hours, so other points are a day's first
            assert all(Q.QUERIES[n](spark, SF).count() >= 0 for n in names)
    finally:
        spark.conf.set("spark.sql.session.timeZone", own)


def test_empty_points(spark):
    none = spark.createDataFrame([], sources.POINT)
    assert convoys.cmc(none, 3, 3, 60.0).count() == 0
    assert convoys.cuts(none, 3, 3, 60.0, 30.0, 4, 250.0).count() == 0
    assert [df.count() for df in convoys.cuts_minutes(none, 3, 1, 3, 60.0, 30.0, 30, 250.0)] == [0, 0]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({Q.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, want))


def test_pair_joins_send_a_segment_few_times_and_no_pair(spark, monkeypatch):
    """A segment goes to FEW groups at most, however many share its place, and the pairs of objects aren't shuffled."""
    rnd = random.Random(3)
    pts = spark.createDataFrame([(i, at(60 * t), rnd.random() * 20, rnd.random() * 20) for i in range(200) for t in range(3)], sources.POINT)
    parts = numbered_segments(assign_windows(simplify.segments(pts), windows.lambda_windows(pts, 3))).cache()
    sent, real = [], joins.grouped
    monkeypatch.setattr(joins, "BLOCK", 8)
    monkeypatch.setattr(joins, "grouped", lambda df, *keys: (sent.append(df.count()), real(df, *keys))[1])
    segs = segment_pairs(parts, 60.0, 250.0, "exact", True)
    pairs = trajectory_pairs(parts, 60.0, 250.0)
    assert max(sent) <= 4 * parts.count()
    assert pairs.count() == 200 * 199 // 2
    assert segs.count() == parts.join(parts.selectExpr("p", "seg as o", "t0 as s0", "t1 as s1"), "p").where("seg < o and t0 <= s1 and t1 >= s0").count()
    assert pairs._jdf.queryExecution().optimizedPlan().toString().startswith("FlatMapGroupsInArrow")


@pytest.mark.parametrize("two,cells,chunk", [(False, None, 64), (True, None, 1 << 20), (True, (5.0, 9.0), 64), (False, (5.0, 9.0), 1 << 20)])
def test_held_against_equals_all_pairs(monkeypatch, two, cells, chunk):
    monkeypatch.setattr(joins, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    n = 120
    col = {"id": np.arange(n) // 2, "t0": rng.integers(0, 9, n), "tolerance": rng.random(n), "side": np.arange(n) // 2 % 2 if two else np.zeros(n, np.int64)}
    col |= {"t1": col["t0"] + rng.integers(0, 4, n), "x0": rng.random(n) * 200, "y0": rng.random(n) * 30}
    col |= {"x1": col["x0"] + rng.random(n) * 9, "y1": col["y0"] - rng.random(n) * 9}
    got = [(i, j) for a, b in joins._held_against(col, lambda x, y: 5.0 + x + y, joins.segment_gap, True, cells) for i, j in zip(a.tolist(), b.tolist())]
    i, j = (x.ravel() for x in np.indices((n, n)))
    ok = (col["side"][i] < col["side"][j]) if two else (col["id"][i] < col["id"][j])
    ok &= (col["t0"][i] <= col["t1"][j]) & (col["t1"][i] >= col["t0"][j])
    box = ("x0", "y0", "x1", "y1")
    ok &= joins.segment_gap([col[c][i] for c in box], [col[c][j] for c in box]) <= 5.0 + col["tolerance"][i] + col["tolerance"][j]
    assert sorted(got) == sorted(zip(i[ok].tolist(), j[ok].tolist())) and got


@pytest.mark.parametrize("own,n", [("id", 40_000), ("seg", 140_000)])
def test_crowds_are_sent_few_times(spark, monkeypatch, own, n):
    """Up to FEW * MOST objects, or segments, of a window in one place go to FEW groups each."""
    sent = []
    monkeypatch.setattr(joins, "grouped", lambda df, *keys: sent.append(df.count()))
    parts = spark.range(n).selectExpr("0L as p", f"id as {own}", "timestamp_seconds(0) as t0", "timestamp_seconds(60) as t1", "id % 7.0D as x0", "0.0D as y0", "1.0D as x1", "id % 5.0D as y1", "0.0D as tolerance")
    joins.block_pairs(parts, own, 60.0, 250.0)
    assert sent == [4 * n]


@pytest.mark.parametrize("name", ["segment_edges_ends", "segment_edges_exact", "segment_pair_edges_endpoint", "traj_pair_edges", "traj_pair_edges_pruned"])
def test_pairs_leave_python_as_lists(spark, name):
    """A row of Python for many pairs, and what is shown of their time or window is made before they are spread."""
    plan = Q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode(others")
    assert "date_format" not in above and "cast(" not in above and "FlatMapGroupsInArrow" in below


@pytest.mark.parametrize("two", [False, True])
@pytest.mark.parametrize("scale,shift,tolerance", [(1.0, 0.0, 0.0), (1.0, 0.0, 3.0), (1.0, 1e9, 2.0), (1e-9, 0.0, 0.0), (1e20, 0.0, 1.0)])
def test_tiles_of_objects_and_segments_equal_all_pairs(monkeypatch, two, scale, shift, tolerance):
    """Also at distances of exactly eps, and where single precision tells little or overflows."""
    monkeypatch.setattr(joins, "TILE", (8, 16))
    monkeypatch.setattr(joins, "CHUNK", 64)
    rng = np.random.default_rng(5)
    n, eps = 150, 5.0 * scale
    col = {"id": rng.permutation(n) // 3, "t0": rng.integers(0, 9, n), "tolerance": np.floor(rng.random(n) * tolerance) * scale}
    col |= {"t1": col["t0"] + rng.integers(0, 4, n), "side": col["id"] % 2 if two else np.zeros(n, np.int64)}
    col |= {c: np.floor(rng.random(n) * (60 if c[0] == "x" else 30)) * scale + shift for c in ("x0", "y0", "x1", "y1")}
    i, j = (x.ravel() for x in np.indices((n, n)))
    meet = (col["t0"][i] <= col["t1"][j]) & (col["t1"][i] >= col["t0"][j])
    apart = (col["side"][i] < col["side"][j]) if two else (i < j)
    box = ("x0", "y0", "x1", "y1")
    table = pa.table({"p": pa.array(np.zeros(n, np.int64))})

    def pairs(ids, tiles):
        out = [tuple(sorted((a, b))) for batch in joins._lists(table, ids, tiles) for a, many in zip(batch.column("one").to_pylist(), batch.column("others").to_pylist()) for b in many]
        assert len(out) == len(set(out)) and out
        return set(out)

    for distance, temporal in (("ends", False), ("exact", True), ("clamped", True)):
        near = joins.SEGMENT_DISTANCES[distance]([col[c][i] for c in box], [col[c][j] for c in box]) <= eps + col["tolerance"][i] + col["tolerance"][j]
        ok = near & apart & (meet | (not temporal))
        assert pairs(np.arange(n), joins._segment_tiles(col, lambda x, y: eps + x + y, joins.SEGMENT_DISTANCES[distance], temporal)) == {tuple(sorted(q)) for q in zip(i[ok].tolist(), j[ok].tolist())}
    near = joins.segment_gap([col[c][i] for c in box], [col[c][j] for c in box]) <= eps + col["tolerance"][i] + col["tolerance"][j]
    ok = near & meet & (col["id"][i] != col["id"][j]) & (apart if two else True)
    want = {tuple(sorted(q)) for q in zip(col["id"][i[ok]].tolist(), col["id"][j[ok]].tolist())}
    for cells in (None, (eps, 12.0 * scale)):
        assert pairs(*joins._object_tiles(col, eps, cells)) == want
