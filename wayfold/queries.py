"""Registered queries of the trajectory engine, over trajectories derived from ``events``, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .functions.values import joined, object_ids, stamp
from .operators import preprocess, recurrence, simplify, windows
from .operators.dbscan import core_points
from .operators.dense import point_clusters
from .operators.joins import assign_windows, near_pairs, numbered_segments, segment_pairs, spread, trajectory_pairs
from .plans import convoys
from .sources.points import CENTRE, FIXTURE_SQL, centroids, events_fixture, laid_routes, map_centre, numbered, routes
from .store import once

#: Parameters of the fixture: objects, snapshots, distance, simplification, times of a window, grid cell.
M, K, EPS, DELTA, SIZE, CELL = 3, 3, 60.0, 30.0, 4, 250.0
#: Least objects of a cluster, and shared ones, in the sweep.
TAUS = (2, 3, 4, 5)
#: Minutes of a window of fixed length.
MINUTES = 3 * 24 * 60
#: The fixture's plane laid on the globe.
GEO_SQL = "SELECT id, time, 116.4 + x / 85000.0 AS x, 39.9 + y / 111000.0 AS y FROM traj"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_fixture(spark, sf_dir)


def _geo(spark, sf_dir) -> DataFrame:
    return _points(spark, sf_dir).select("id", "time", (116.4 + F.col("x") / 85000.0).alias("x"), (39.9 + F.col("y") / 111000.0).alias("y"))


def _raw(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("time"), ((F.col("user_id") % 5) * 400.0 + F.col("value")).alias("x"), F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("y"))


def _members(spark, sf_dir):
    return convoys.snapshot_members(_points(spark, sf_dir), EPS, M)


def _segments(spark, sf_dir):
    return simplify.segments(_points(spark, sf_dir))


def _windows_of(spark, sf_dir):
    return windows.lambda_windows(_points(spark, sf_dir), SIZE)


def _convoy_rows(df: DataFrame) -> DataFrame:
    return df.select(joined(F.col("objects")).alias("objects"), stamp(F.col("start_time")).alias("start_time"), stamp(F.col("end_time")).alias("end_time"), F.col("lifetime_points").cast("long").alias("lifetime_points"))


def coord_filter_window(s, d):
    df = preprocess.in_window(preprocess.valid_points(_points(s, d), 400.0, 30.0), F.to_timestamp(F.lit("2024-01-05")), F.to_timestamp(F.lit("2024-01-20")))
    return df.select("id", stamp(F.col("time")).alias("time"), "x", "y")


def bin_dedupe_10min(s, d):
    return preprocess.bin_and_dedupe(_raw(s, d)).select("id", stamp(F.col("time")).alias("time"), "x", "y")


def trajectory_stats(s, d):
    return preprocess.trajectory_stats(_points(s, d)).select("id", "n_points", "n_times", stamp(F.col("first_time")).alias("first_time"), stamp(F.col("last_time")).alias("last_time"), F.round("mean_x", 6).alias("mean_x"), F.round("mean_y", 6).alias("mean_y"))


def local_projection(s, d):
    return preprocess.local_projection(_geo(s, d)).select("id", stamp(F.col("time")).alias("time"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def haversine_consecutive(s, d):
    g = simplify.segments(_geo(s, d))
    return g.select("id", stamp(F.col("t0")).alias("t0"), F.round(geo.haversine(*map(F.col, ("x0", "y0", "x1", "y1"))), 3).alias("meters"))


def stay_points(s, d):
    return preprocess.remove_stay_points(_points(s, d), 100.0, 1440.0, planar=True).select("id", stamp(F.col("time")).alias("time"), "x", "y")


def _spans(s, d):
    p = _points(s, d)
    return p.groupBy("id").agg(F.min("time").alias("start_time"), F.max("time").alias("end_time")).select(F.lit(0).alias("track"), "id", "start_time", "end_time")


def _grid_rows(df):
    return df.select("id", stamp(F.col("time")).alias("time"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def time_grid_interpolate(s, d):
    return _grid_rows(windows.interpolate(_points(s, d), _spans(s, d), "12 hours"))


def interpolate_asof_window(s, d):
    spans = _points(s, d).select("id").distinct().select(F.lit(0).alias("track"), "id", F.to_timestamp(F.lit("2024-01-10")).alias("start_time"), F.to_timestamp(F.lit("2024-01-14")).alias("end_time"))
    return _grid_rows(windows.interpolate(_points(s, d), spans, "1 day", reach_out=True))


def lambda_windows(s, d):
    return _windows_of(s, d).select(F.col("p").cast("long").alias("p"), stamp(F.col("p_start")).alias("p_start"), stamp(F.col("p_end")).alias("p_end"))


def _dp(line):
    def run(s, d):
        return simplify.simplify(_points(s, d), DELTA, line).where("kept").select("id", stamp(F.col("time")).alias("time"), "x", "y")

    return run


def dp_segments_tolerance(s, d):
    g = simplify.segments(simplify.simplify(_points(s, d), DELTA))
    return g.select("id", stamp(F.col("t0")).alias("t0"), stamp(F.col("t1")).alias("t1"), F.round("tolerance", 6).alias("tolerance"))


def dp_reduction_stats(s, d):
    return simplify.simplification_stats(simplify.simplify(_points(s, d), DELTA)).withColumn("reduction_percent", F.round("reduction_percent", 6))


def segment_partition_join(s, d):
    return assign_windows(_segments(s, d), _windows_of(s, d)).select("id", stamp(F.col("t0")).alias("t0"), F.col("p").cast("long").alias("p"))


def _segment_pairs(s, d):
    """Each object's segments with its next one but one."""
    from pyspark.sql import Window

    names = ("x0", "y0", "x1", "y1")
    w = Window.partitionBy("id").orderBy("t0")
    return _segments(s, d).select("id", "t0", *names, *(F.lead(c, 2).over(w).alias(f"n{c}") for c in names)).where("nx0 is not null")


_EIGHT = ("x0", "y0", "x1", "y1", "nx0", "ny0", "nx1", "ny1")


def point_segment_distance(s, d):
    six = tuple(map(F.col, ("nx0", "ny0", "x0", "y0", "x1", "y1")))
    far = F.round(geo.point_segment(*six), 6).alias("d"), F.round(geo.point_line(*six), 6).alias("d_line")
    return _segment_pairs(s, d).select("id", stamp(F.col("t0")).alias("t0"), *far)


def segments_intersect(s, d):
    return _segment_pairs(s, d).select("id", stamp(F.col("t0")).alias("t0"), geo.segments_intersect(*map(F.col, _EIGHT)).alias("meets"))


def segment_distance(s, d):
    return _segment_pairs(s, d).select("id", stamp(F.col("t0")).alias("t0"), F.round(geo.segment_segment(*map(F.col, _EIGHT)), 6).alias("d"))


def _traj_pairs(lemma):
    def run(s, d):
        segs = simplify.segments(simplify.simplify(_points(s, d), DELTA))
        lists = trajectory_pairs(assign_windows(segs, _windows_of(s, d)), EPS, CELL, lemma, lists=True)
        return spread(lists.withColumn("p", F.col("p").cast("long")))

    return run


def segment_pair_edges_endpoint(s, d):
    """Unsimplified segments of a day whose distance is at most EPS, by the same grid join."""
    segs = _segments(s, d).withColumnsRenamed({"t0": "p"}).withColumn("t0", F.col("p"))
    lists = trajectory_pairs(segs, EPS, CELL, lists=True)
    return spread(lists.withColumn("p", stamp(F.col("p")))).withColumnRenamed("p", "t0")  # a stamp for each list, not for each pair


def fixed_windows(s, d):
    w = windows.fixed_windows(_points(s, d), MINUTES)
    return w.select(F.col("p").cast("long").alias("p"), stamp(F.col("p_start")).alias("p_start"), stamp(F.col("p_end")).alias("p_end"))


def _segment_edges(distance, temporal):
    """Unsimplified segments of a window of fixed length, numbered in it, that are at most EPS apart."""

    def run(s, d):
        pts = _points(s, d)
        parts = numbered_segments(assign_windows(simplify.segments(pts), windows.fixed_windows(pts, MINUTES)))
        lists = segment_pairs(parts, EPS, CELL, distance, temporal, lists=True)
        return spread(lists.withColumn("p", F.col("p").cast("long")))

    return run


def _minutes_cuts(s, d):
    return convoys.cuts_minutes(_points(s, d), M, 2, K, EPS, DELTA, MINUTES, CELL, dedupe=True, distance="exact", temporal=True, drop_small=True)


def cuts_minutes_candidates(s, d):
    return _convoy_rows(_minutes_cuts(s, d)[1])


def cuts_minutes_convoys(s, d):
    return _convoy_rows(_minutes_cuts(s, d)[0])


def eps_neighbor_pairs(s, d):
    return near_pairs(_points(s, d), EPS).select(stamp(F.col("time")).alias("time"), "a", "b")


def eps_neighbor_pairs_haversine(s, d):
    return near_pairs(_geo(s, d), EPS, geographic=True).select(stamp(F.col("time")).alias("time"), "a", "b")


def dbscan_core_border(s, d):
    return core_points(near_pairs(_points(s, d), EPS), M).select(stamp(F.col("time")).alias("time"), "id", "neighbours", "core")


def snapshot_clusters(s, d):
    return _members(s, d).select(stamp(F.col("time")).alias("time"), "label", "id")


def traj_clusters(s, d):
    return convoys.partition_clusters(_points(s, d), M, EPS, DELTA, SIZE, CELL)[1].select(F.col("p").cast("long").alias("p"), "label", "id")


def cmc_convoys(s, d):
    return _convoy_rows(convoys.cmc(_points(s, d), M, K, EPS))


def _candidates(s, d):
    return convoys.cuts_filter(_points(s, d), M, K, EPS, DELTA, SIZE, CELL)


def cuts_candidates(s, d):
    return _convoy_rows(_candidates(s, d))


def cuts_convoys(s, d):
    return _convoy_rows(convoys.cuts(_points(s, d), M, K, EPS, DELTA, SIZE, CELL, "1 day"))


def cuts_filter_log(s, d):
    log = convoys.filter_log(_points(s, d), M, K, EPS, DELTA, SIZE, CELL)
    stamps = (stamp(F.col(c)).alias(c) for c in ("p_start", "p_end"))
    return log.select(F.col("p").cast("long").alias("p"), *stamps, "objects_in_partition", "filter_clusters", "active_candidates")


def cmc_vs_cuts_coverage(s, d):
    found = recurrence.coverage(convoys.cmc(_points(s, d), M, K, EPS), _candidates(s, d))
    return found.groupBy("covered").agg(F.count(F.lit(1)).alias("n_convoys"))


def _numbered(s, d):
    return recurrence.numbered_members(_members(s, d))


def recurrent_clusters_rci(s, d):
    return recurrence.shared_members(_numbered(s, d), 3).select(F.col("earlier").cast("long").alias("earlier"), F.col("later").cast("long").alias("later"), "shared")


def _boxes(s, d):
    return recurrence.box_overlaps(recurrence.cluster_boxes(_numbered(s, d), _points(s, d)))


def cluster_bbox_overlap(s, d):
    return _boxes(s, d).select(F.col("earlier").cast("long").alias("earlier"), F.col("later").cast("long").alias("later"))


def cluster_hausdorff(s, d):
    members = once(_numbered(s, d))
    h = recurrence.hausdorff(recurrence.box_overlaps(recurrence.cluster_boxes(members, _points(s, d))), members, _points(s, d))
    return h.select(F.col("earlier").cast("long").alias("earlier"), F.col("later").cast("long").alias("later"), F.round("hausdorff", 6).alias("hausdorff"))


def tau_sweep(s, d):
    """Clusters of at least tau objects, found anew for each tau, that share at least tau objects."""
    points = _points(s, d)
    out = None
    for tau in TAUS:
        shared = recurrence.shared_members(recurrence.numbered_members(point_clusters(points, EPS, tau, alone=False)), tau)
        one = shared.agg(F.count(F.lit(1)).alias("n_pairs")).select(F.lit(tau).cast("long").alias("tau"), "n_pairs")
        out = one if out is None else out.unionByName(one)
    return out


def parse_object_ids(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", joined(object_ids(F.concat_ws(" ", F.lit("{np.int64("), "user_id", "props", F.lit("), 7}")))).alias("ids"))


def convoy_summary_numbered(s, d):
    n = numbered(convoys.cmc(_points(s, d), M, K, EPS))
    longs = (F.col(c).cast("long").alias(c) for c in ("convoy_id", "object_count", "lifetime_points", "lifetime_minutes"))
    return n.select(*longs, "objects", stamp(F.col("start_time")).alias("start_time"), stamp(F.col("end_time")).alias("end_time"))


def _identified(s, d):
    n = numbered(convoys.cmc(_points(s, d), M, K, EPS))
    return n.select("convoy_id", object_ids(F.col("objects")).alias("objects"), "start_time", "end_time")


def convoy_routes(s, d):
    return routes(_points(s, d), _identified(s, d)).select(F.col("convoy_id").cast("long").alias("convoy_id"), "id", stamp(F.col("time")).alias("time"), "x", "y")


def convoy_centroids(s, d):
    c = centroids(_points(s, d), _identified(s, d))
    return c.select(F.col("convoy_id").cast("long").alias("convoy_id"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "n_points")


def cmc_convoys_haversine(s, d):
    return _convoy_rows(convoys.cmc(_geo(s, d), M, K, EPS, geographic=True))


def segment_distance_variants(s, d):
    """Distances of segments by their ends, and without the test of crossing."""
    names = tuple(map(F.col, _EIGHT))
    return _segment_pairs(s, d).select("id", stamp(F.col("t0")).alias("t0"), F.round(geo.segment_ends(*names), 6).alias("d_ends"), F.round(geo.segment_clamped(*names), 6).alias("d_clamped"))


def equirectangular_xy(s, d):
    x, y = geo.equirectangular(F.col("x"), F.col("y"), F.lit(39.9))
    return _geo(s, d).select("id", stamp(F.col("time")).alias("time"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(geo.degrees_to_meters(F.col("x") - 116.4), 3).alias("rough_x"))


def map_centre_point(s, d):
    return map_centre(_geo(s, d)).select(F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


def first_objects(s, d):
    return preprocess.first_objects(_points(s, d), 20).select("id", stamp(F.col("time")).alias("time"), "x", "y")


def nth_object(s, d):
    return preprocess.nth_object(_points(s, d), 3).select("id", stamp(F.col("time")).alias("time"), "x", "y")


def laid_convoy_routes(s, d):
    """Routes of the convoys on a grid of half days, as the map of saved convoys draws them."""
    r = laid_routes(_points(s, d), _identified(s, d), "12 hours")
    return r.select(F.col("convoy_id").cast("long").alias("convoy_id"), "id", stamp(F.col("time")).alias("time"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


QUERIES = {
    f.__name__: f
    for f in (
        coord_filter_window, bin_dedupe_10min, trajectory_stats, local_projection, haversine_consecutive, stay_points, time_grid_interpolate, interpolate_asof_window,
        lambda_windows, dp_segments_tolerance, dp_reduction_stats, segment_partition_join, point_segment_distance, segments_intersect, segment_distance,
        segment_pair_edges_endpoint, eps_neighbor_pairs, eps_neighbor_pairs_haversine, dbscan_core_border, snapshot_clusters, traj_clusters, cmc_convoys,
        cuts_candidates, cuts_convoys, cuts_filter_log, cmc_vs_cuts_coverage, recurrent_clusters_rci, cluster_bbox_overlap, cluster_hausdorff, tau_sweep,
        parse_object_ids, convoy_summary_numbered, convoy_routes, convoy_centroids, fixed_windows, cuts_minutes_candidates, cuts_minutes_convoys,
        cmc_convoys_haversine, segment_distance_variants, equirectangular_xy, map_centre_point, first_objects, nth_object, laid_convoy_routes,
    )
} | {"dp_keep_points": _dp(False), "dp_line_variant": _dp(True), "traj_pair_edges": _traj_pairs(False), "traj_pair_edges_pruned": _traj_pairs(True), "segment_edges_ends": _segment_edges("ends", False), "segment_edges_exact": _segment_edges("exact", True)}

# --- SQL ----------------------------------------------------------------------

_TRAJ = f"traj AS ({FIXTURE_SQL.format(events='events')})"
_T = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
_EDGES = f"edges AS (SELECT a.time, a.id AS a, b.id AS b FROM traj a JOIN traj b ON a.time = b.time AND a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {EPS})"


def _clusters(edges: str, m: int = M, tail: str = "", drop_small: bool = False) -> str:
    """CTEs from ``edges`` (time, a, b) to ``deg``, ``core`` and ``members`` (time, label, id), their names ended by ``tail``."""
    small = f" QUALIFY count(*) OVER (PARTITION BY time, label) >= {m}" if drop_small else ""
    return f"""both_ways{tail} AS (SELECT time, a, b FROM {edges} UNION ALL SELECT time, b, a FROM {edges}),
 deg{tail} AS (SELECT time, a AS id, count(*) + 1 AS neighbours FROM both_ways{tail} GROUP BY time, a),
 core{tail} AS (SELECT time, id FROM deg{tail} WHERE neighbours >= {m}),
 core_edges{tail} AS (SELECT e.* FROM both_ways{tail} e JOIN core{tail} c ON e.time = c.time AND e.a = c.id JOIN core{tail} d ON e.time = d.time AND e.b = d.id),
 reach{tail} AS (SELECT time, id AS a, id AS b FROM core{tail} UNION SELECT r.time, r.a, e.b FROM reach{tail} r JOIN core_edges{tail} e ON r.time = e.time AND r.b = e.a),
 labels{tail} AS (SELECT time, a AS id, min(b) AS label FROM reach{tail} GROUP BY time, a),
 every{tail} AS (SELECT time, label, id FROM labels{tail} UNION ALL
   SELECT e.time, min(l.label), e.a FROM both_ways{tail} e JOIN labels{tail} l ON e.time = l.time AND e.b = l.id
   WHERE NOT EXISTS (SELECT 1 FROM core{tail} c WHERE c.time = e.time AND c.id = e.a) GROUP BY e.time, e.a),
 members{tail} AS (SELECT time, label, id FROM every{tail}{small})"""


_CLUSTERS = f"{_EDGES}, {_clusters('edges')}"
_STEP_SETS = "sets{0} AS (SELECT time, list_sort(list(DISTINCT id)) AS objs FROM members{0} GROUP BY time, label)"


def _fold(steps: str, k: int, points: int = 1, dedupe: bool = False, new_needs_m: bool = False, tail: str = "") -> str:
    """CTEs from ``steps`` (track, n from 1, s, e, cs: lists of objects) to ``fold`` and ``convoys`` (track, o, objects, s, e, l)."""
    goes_on = f"list_filter(st.cs, lambda c: len(list_intersect(v.o, c)) >= {M})"
    met = f"len(list_filter(f.act, lambda v: len(list_intersect(v.o, c)) >= {M})) = 0" + (f" AND len(c) >= {M}" if new_needs_m else "")
    kind = "STRUCT(o BIGINT[], s TIMESTAMP, e TIMESTAMP, l BIGINT)[]"
    act = f"""list_concat(
       flatten(list_transform(f.act, lambda v: list_transform({goes_on}, lambda c: struct_pack(o := list_sort(list_intersect(v.o, c)), s := v.s, e := st.e, l := v.l + {points})))),
       list_transform(list_filter(st.cs, lambda c: {met}), lambda c: struct_pack(o := c, s := st.s, e := st.e, l := {points}::BIGINT)))"""
    return f"""fold{tail} AS (
   SELECT DISTINCT track, 0::BIGINT AS n, []::{kind} AS act, []::{kind} AS done FROM {steps}
   UNION ALL
   SELECT st.track, st.n, {f"list_distinct({act})" if dedupe else act},
     list_concat(f.done, list_filter(f.act, lambda v: v.l >= {k} AND len({goes_on}) = 0))
   FROM fold{tail} f JOIN {steps} st ON st.track = f.track AND st.n = f.n + 1),
 ends{tail} AS (SELECT track, list_concat(done, list_filter(act, lambda v: v.l >= {k})) AS vs FROM fold{tail} QUALIFY n = max(n) OVER (PARTITION BY track)),
 convoys{tail} AS (SELECT track, v.o AS o, array_to_string(v.o, ',') AS objects, v.s AS s, v.e AS e, v.l AS l FROM (SELECT track, unnest(vs) AS v FROM ends{tail}))"""


def _cs(sets: str, at: str) -> str:
    return f"coalesce((SELECT list(x.objs ORDER BY x.objs) FROM {sets} x WHERE x.time = {at}), [])"


_FOLD = f"""{_STEP_SETS.format('')},
 steps AS (SELECT 0 AS track, row_number() OVER (ORDER BY t.time) AS n, t.time AS s, t.time AS e, {_cs('sets', 't.time')} AS cs FROM (SELECT DISTINCT time FROM traj) t),
 {_fold('steps', K)}"""
_SEGS = "segs AS (SELECT * FROM (SELECT id, time AS t0, lead(time) OVER w AS t1, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM traj WINDOW w AS (PARTITION BY id ORDER BY time)) WHERE t1 IS NOT NULL)"
_PAIRS = f"""{_SEGS}, pairs AS (SELECT * FROM (
   SELECT id, t0, x0, y0, x1, y1, lead(x0, 2) OVER w AS nx0, lead(y0, 2) OVER w AS ny0, lead(x1, 2) OVER w AS nx1, lead(y1, 2) OVER w AS ny1
   FROM segs WINDOW w AS (PARTITION BY id ORDER BY t0)) WHERE nx0 IS NOT NULL)"""
_WINDOWS = f"""nth AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM traj)),
 wins AS (SELECT a.i // {SIZE - 1} AS p, a.time AS p_start, b.time AS p_end FROM nth a JOIN nth b ON b.i = least(a.i + {SIZE - 1}, a.n - 1) WHERE a.i % {SIZE - 1} = 0 AND a.i < a.n - 1)"""


def _hyp(ax, ay, bx, by):
    return f"sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"


def _ps(px, py, ax, ay, bx, by):
    size = f"(({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))"
    t = f"greatest(0.0, least(1.0, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / {size}))"
    return f"CASE WHEN {size} = 0 THEN {_hyp(px, py, ax, ay)} ELSE {_hyp(px, py, f'({ax} + {t} * ({bx} - {ax}))', f'({ay} + {t} * ({by} - {ay}))')} END"


def _o(ax, ay, bx, by, cx, cy):
    return f"(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


def _on(ax, ay, bx, by, px, py):
    return f"({px} >= least({ax}, {bx}) - 1e-12 AND {px} <= greatest({ax}, {bx}) + 1e-12 AND {py} >= least({ay}, {by}) - 1e-12 AND {py} <= greatest({ay}, {by}) + 1e-12)"


def _meets(a, b):
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, b
    o = _o(ax, ay, bx, by, cx, cy), _o(ax, ay, bx, by, dx, dy), _o(cx, cy, dx, dy, ax, ay), _o(cx, cy, dx, dy, bx, by)
    on = _on(ax, ay, bx, by, cx, cy), _on(ax, ay, bx, by, dx, dy), _on(cx, cy, dx, dy, ax, ay), _on(cx, cy, dx, dy, bx, by)
    return f"({o[0]} * {o[1]} < 0 AND {o[2]} * {o[3]} < 0) OR " + " OR ".join(f"(abs({x}) < 1e-12 AND {y})" for x, y in zip(o, on))


def _ss(a, b):
    ends = ", ".join((_ps(*a[:2], *b), _ps(*a[2:], *b), _ps(*b[:2], *a), _ps(*b[2:], *a)))
    return f"CASE WHEN {_meets(a, b)} THEN 0.0 ELSE least({ends}) END"


_A, _B = ("x0", "y0", "x1", "y1"), ("nx0", "ny0", "nx1", "ny1")
_NUMBERED = "numbered AS (SELECT DISTINCT time, label, id, dense_rank() OVER (ORDER BY time, label) AS seq FROM members)"
_BOXES = """spots AS (SELECT n.seq, n.id, t.x, t.y FROM numbered n JOIN traj t ON n.time = t.time AND n.id = t.id),
 boxes AS (SELECT seq, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM spots GROUP BY seq),
 meets AS (SELECT a.seq AS earlier, b.seq AS later FROM boxes a JOIN boxes b ON a.seq < b.seq AND a.lx <= b.hx AND b.lx <= a.hx AND a.ly <= b.hy AND b.ly <= a.hy)"""
_SHARED = "shared AS (SELECT a.seq AS earlier, b.seq AS later, count(*) AS shared FROM numbered a JOIN numbered b ON a.id = b.id AND a.seq < b.seq GROUP BY ALL)"
_CONVOY_NO = f"no AS (SELECT row_number() OVER (ORDER BY s, len(o) DESC, objects, e) AS convoy_id, * FROM convoys)"
_ROUTES = "routes AS (SELECT c.convoy_id, t.id, t.time, t.x, t.y FROM (SELECT convoy_id, s, e, unnest(o) AS id FROM no) c JOIN traj t ON t.id = c.id AND t.time BETWEEN c.s AND c.e)"
_HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({y1} - {y0}) / 2), 2) + cos(radians({y0})) * cos(radians({y1})) * pow(sin(radians({x1} - {x0}) / 2), 2))))"
_BIN = "make_timestamp(CAST(round_even(epoch_us(time) / 600000000.0, 0) AS BIGINT) * 600000000)"

_FIXED = f"fixed AS (SELECT row_number() OVER (ORDER BY p_start) - 1 AS p, p_start, p_start + INTERVAL {MINUTES} MINUTES AS p_end FROM (SELECT unnest(generate_series(min(time), max(time), INTERVAL {MINUTES} MINUTES)) AS p_start FROM traj))"
_PARTS = f"{_SEGS}, {_FIXED}, parts AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY id, t0) AS seg, t0, t1, x0, y0, x1, y1 FROM segs JOIN fixed ON t1 >= p_start AND t0 <= p_end)"


def _between(by: str) -> str:
    """CTE bodies that lay known points (``known``) on a grid (``grid``), each of ``by`` and time."""
    return f"""allt AS (SELECT {by}, time, max(x) AS x, max(y) AS y, bool_or(g) AS g FROM (
     SELECT {by}, time, x, y, false AS g FROM known UNION ALL SELECT {by}, time, NULL, NULL, true FROM grid) GROUP BY {by}, time),
 spot AS (SELECT *, CASE WHEN x IS NOT NULL THEN struct_pack(t := time, x := x, y := y) END AS q FROM allt),
 nb AS (SELECT *, last_value(q IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo,
   first_value(q IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM spot),
 part AS (SELECT *, CASE WHEN lo.t = hi.t THEN 0.0 ELSE (epoch_us(time) - epoch_us(lo.t)) / (epoch_us(hi.t) - epoch_us(lo.t)) END AS f FROM nb WHERE g AND lo IS NOT NULL AND hi IS NOT NULL),
 laid AS (SELECT {by}, time, lo.x + (hi.x - lo.x) * f AS x, lo.y + (hi.y - lo.y) * f AS y FROM part)"""


def _interp(known: str, grid: str) -> str:
    return f"known AS ({known}), grid AS ({grid}), {_between('id')} SELECT id, {_T('time')} AS time, round(x, 6) AS x, round(y, 6) AS y FROM laid"


def _dp(line: bool = False) -> str:
    """CTEs of the simplification: ``pts`` by place, ``spans`` that are split, ``kept`` points, ``dsegs`` with tolerance."""
    ends = ("u.x", "u.y", "v.x", "v.y")
    size = _hyp(*ends)
    far = _ps("p.x", "p.y", *ends)
    if line:
        far = f"CASE WHEN {size} = 0 THEN {_hyp('p.x', 'p.y', 'u.x', 'u.y')} ELSE abs((v.x - u.x) * (u.y - p.y) - (u.x - p.x) * (v.y - u.y)) / {size} END"
    own = _ps("p.x", "p.y", "s.x0", "s.y0", "s.x1", "s.y1")
    return f"""pts AS MATERIALIZED (SELECT id, time, x, y, row_number() OVER (PARTITION BY id ORDER BY time) - 1 AS i FROM traj),
 spans AS (SELECT id, 0::BIGINT AS a, max(i) AS b FROM pts GROUP BY id UNION ALL
   SELECT id, unnest([a, k]) AS a, unnest([k, b]) AS b FROM (
     SELECT *, row_number() OVER (PARTITION BY id, a, b ORDER BY d DESC, k) AS rn FROM (
       SELECT s.id, s.a, s.b, p.i AS k, {far} AS d FROM spans s JOIN pts p ON p.id = s.id AND p.i > s.a AND p.i < s.b
       JOIN pts u ON u.id = s.id AND u.i = s.a JOIN pts v ON v.id = s.id AND v.i = s.b)) WHERE rn = 1 AND d > {DELTA}),
 kept AS (SELECT DISTINCT p.id, p.i, p.time, p.x, p.y FROM spans s JOIN pts p ON p.id = s.id AND (p.i = s.a OR p.i = s.b)),
 whole AS (SELECT * FROM (SELECT id, i, lead(i) OVER w AS j, time AS t0, lead(time) OVER w AS t1, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1
   FROM kept WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE j IS NOT NULL),
 dsegs AS MATERIALIZED (SELECT s.id, s.t0, s.t1, s.x0, s.y0, s.x1, s.y1, coalesce(max({own}), 0.0) AS tolerance
   FROM whole s LEFT JOIN pts p ON p.id = s.id AND p.i > s.i AND p.i < s.j GROUP BY s.id, s.t0, s.t1, s.x0, s.y0, s.x1, s.y1)"""


_ENDS_A, _ENDS_B = (tuple(f"{s}.{c}" for c in ("x0", "y0", "x1", "y1")) for s in "ab")
_SIMPLE = _dp()
_TPAIRS = f"""{_SIMPLE}, {_WINDOWS}, tparts AS MATERIALIZED (SELECT p, d.* FROM dsegs d JOIN wins ON t1 >= p_start AND t0 <= p_end),
 tedges AS MATERIALIZED (SELECT DISTINCT a.p AS time, a.id AS a, b.id AS b FROM tparts a JOIN tparts b ON a.p = b.p AND a.id < b.id AND a.t0 <= b.t1 AND a.t1 >= b.t0
   WHERE greatest(0.0, ({_ss(_ENDS_A, _ENDS_B)}) - a.tolerance - b.tolerance) <= {EPS})"""
_TCLUSTERS = f"{_TPAIRS}, {_clusters('tedges', tail='_t', drop_small=True)}"
_CANDIDATES = f"""{_TCLUSTERS}, {_STEP_SETS.format('_t')},
 wsteps AS (SELECT 0 AS track, row_number() OVER (ORDER BY p) AS n, p_start AS s, p_end AS e, {_cs('sets_t', 'w.p')} AS cs FROM wins w),
 {_fold('wsteps', K, SIZE, dedupe=True, new_needs_m=True, tail='_w')},
 cands AS (SELECT o, objects, s, e, max(l) AS l, row_number() OVER (ORDER BY s, e, o) AS track FROM convoys_w GROUP BY o, objects, s, e)"""
_REFINED = f"""{_CANDIDATES}, spans_of AS (SELECT track, unnest(o) AS id, s, e FROM cands),
 known AS (SELECT c.track, t.id, t.time, t.x, t.y FROM spans_of c JOIN traj t ON t.id = c.id AND t.time BETWEEN c.s AND c.e),
 grid AS (SELECT track, id, unnest(generate_series(s, e, INTERVAL 1 DAY)) AS time FROM spans_of), {_between('track, id')},
 snaps AS MATERIALIZED (SELECT struct_pack(track := track, t := time) AS time, id, x, y FROM laid),
 redges AS MATERIALIZED (SELECT a.time, a.id AS a, b.id AS b FROM snaps a JOIN snaps b ON a.time = b.time AND a.id < b.id AND {_hyp('a.x', 'a.y', 'b.x', 'b.y')} <= {EPS}),
 {_clusters('redges', tail='_r', drop_small=True)}, {_STEP_SETS.format('_r')},
 rsteps AS (SELECT time.track AS track, row_number() OVER (PARTITION BY time.track ORDER BY time.t) AS n, time.t AS s, time.t AS e, {_cs('sets_r', 'q.time')} AS cs FROM (SELECT DISTINCT time FROM snaps) q),
 {_fold('rsteps', K, dedupe=True, tail='_r')},
 refined AS (SELECT objects, s, e, max(l) AS l FROM convoys_r WHERE len(o) >= {M} GROUP BY objects, s, e)"""
_MINUTES_FOUND = f"""{_SIMPLE}, {_FIXED},
 mparts AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY id, t0) AS seg, d.* FROM dsegs d JOIN fixed ON t1 >= p_start AND t0 <= p_end),
 medges AS MATERIALIZED (SELECT a.p AS time, a.seg AS a, b.seg AS b FROM mparts a JOIN mparts b ON a.p = b.p AND a.seg < b.seg AND a.t0 <= b.t1 AND a.t1 >= b.t0
   WHERE ({_ss(_ENDS_A, _ENDS_B)}) <= {EPS} + a.tolerance + b.tolerance),
 {_clusters('medges', tail='_m')},
 sets_m AS (SELECT m.time, list_sort(list(DISTINCT q.id)) AS objs FROM members_m m JOIN mparts q ON q.p = m.time AND q.seg = m.id GROUP BY m.time, m.label HAVING count(DISTINCT q.id) >= {M}),
 msteps AS (SELECT 0 AS track, row_number() OVER (ORDER BY p) AS n, p_start AS s, p_end AS e, {_cs('sets_m', 'w.p')} AS cs FROM fixed w),
 {_fold('msteps', 2, tail='_m')}"""
_MINUTES_REFINED = f"""{_MINUTES_FOUND}, mcands AS (SELECT *, row_number() OVER (ORDER BY s, e, o) AS no FROM convoys_m),
 own AS MATERIALIZED (SELECT struct_pack(track := c.no, t := t.time) AS time, t.id, t.x, t.y FROM (SELECT no, s, e, unnest(o) AS id FROM mcands) c JOIN traj t ON t.id = c.id AND t.time BETWEEN c.s AND c.e),
 oedges AS MATERIALIZED (SELECT a.time, a.id AS a, b.id AS b FROM own a JOIN own b ON a.time = b.time AND a.id < b.id AND {_hyp('a.x', 'a.y', 'b.x', 'b.y')} <= {EPS}),
 {_clusters('oedges', tail='_o')}, {_STEP_SETS.format('_o')},
 osteps AS (SELECT time.track AS track, row_number() OVER (PARTITION BY time.track ORDER BY time.t) AS n, time.t AS s, time.t AS e, {_cs('sets_o', 'q.time')} AS cs FROM (SELECT DISTINCT time FROM own) q),
 {_fold('osteps', K, tail='_o')}"""
_ORDER = "nth_of AS (SELECT id, row_number() OVER (ORDER BY min(time), id) - 1 AS nth FROM traj GROUP BY id)"
_SHOWN = f"objects, {_T('s')} AS start_time, {_T('e')} AS end_time, l AS lifetime_points"
#: A point's stay ends before the first later one that is too far; the walk goes on behind a stay, or at the next point.
_STAYS = f"""pts AS (SELECT id, time, x, y, row_number() OVER (PARTITION BY id ORDER BY time, x, y) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM traj),
 runs AS (SELECT a.id, a.i, a.n, coalesce(min(b.i) FILTER ({_hyp('a.x', 'a.y', 'b.x', 'b.y')} > 100.0), a.n) AS j FROM pts a LEFT JOIN pts b ON b.id = a.id AND b.i > a.i GROUP BY a.id, a.i, a.n),
 stays AS (SELECT r.id, r.i, r.n, r.j, r.j - 1 > r.i AND epoch_us(z.time) - epoch_us(a.time) >= 1440 * 60000000::BIGINT AS stay FROM runs r JOIN pts a ON a.id = r.id AND a.i = r.i JOIN pts z ON z.id = r.id AND z.i = r.j - 1),
 walk AS (SELECT * FROM stays WHERE i = 0 UNION ALL SELECT s.* FROM walk w JOIN stays s ON s.id = w.id AND s.i = CASE WHEN w.stay THEN w.j ELSE w.i + 1 END),
 moving AS (SELECT p.* FROM pts p WHERE NOT EXISTS (SELECT 1 FROM walk w WHERE w.stay AND w.id = p.id AND p.i >= w.i AND p.i < w.j))"""


def _taus() -> str:
    out, ends = [], []
    for tau in TAUS:
        t = f"_{tau}"
        out.append(f"{_clusters('edges', tau, t)}, no{t} AS (SELECT DISTINCT time, label, id, dense_rank() OVER (ORDER BY time, label) AS seq FROM members{t})")
        pairs = f"SELECT a.seq FROM no{t} a JOIN no{t} b ON a.id = b.id AND a.seq < b.seq GROUP BY a.seq, b.seq HAVING count(*) >= {tau}"
        ends.append(f"SELECT {tau}::BIGINT AS tau, count(*) AS n_pairs FROM ({pairs})")
    return f"{_EDGES}, {', '.join(out)} {' UNION ALL '.join(ends)}"


_REC = "WITH RECURSIVE " + _TRAJ + ", "
ORACLE_SQL = {
    "coord_filter_window": f"WITH {_TRAJ} SELECT id, {_T('time')} AS time, x, y FROM traj WHERE x > 400 AND y > 30 AND time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'",
    "bin_dedupe_10min": f"""WITH raw AS (SELECT user_id AS id, CAST(ts AS TIMESTAMP) AS time, (user_id % 5) * 400.0 + value AS x, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y FROM events),
        b AS (SELECT *, {_BIN} AS bin FROM raw), r AS (SELECT *, row_number() OVER (PARTITION BY id, bin ORDER BY time, x, y) AS rn FROM b)
        SELECT id, {_T('bin')} AS time, x, y FROM r WHERE rn = 1""",
    "trajectory_stats": f"WITH {_TRAJ} SELECT id, count(*) AS n_points, count(DISTINCT time) AS n_times, {_T('min(time)')} AS first_time, {_T('max(time)')} AS last_time, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y FROM traj GROUP BY id",
    "local_projection": f"WITH {_TRAJ}, g AS ({GEO_SQL}), m AS (SELECT avg(x) AS x0, avg(y) AS y0 FROM g) SELECT id, {_T('time')} AS time, round((x - x0) * 111320.0 * cos(radians(y0)), 3) AS x, round((y - y0) * 111320.0, 3) AS y FROM g, m",
    "haversine_consecutive": f"WITH {_TRAJ.replace('traj AS', 'traj0 AS')}, traj AS ({GEO_SQL.replace('FROM traj', 'FROM traj0')}), {_SEGS} SELECT id, {_T('t0')} AS t0, round({_HAV.format(x0='x0', y0='y0', x1='x1', y1='y1')}, 3) AS meters FROM segs",
    "time_grid_interpolate": f"WITH {_TRAJ}, " + _interp("SELECT id, time, x, y FROM traj", "SELECT id, unnest(generate_series(min(time), max(time), INTERVAL 12 HOURS)) AS time FROM traj GROUP BY id"),
    "interpolate_asof_window": f"WITH {_TRAJ}, s AS (SELECT id, max(time) FILTER (time < TIMESTAMP '2024-01-10') AS b, min(time) FILTER (time > TIMESTAMP '2024-01-14') AS a FROM traj GROUP BY id), "
    + _interp(
        "SELECT t.id, t.time, t.x, t.y FROM traj t JOIN s ON t.id = s.id WHERE t.time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-14' OR t.time = s.b OR t.time = s.a",
        "SELECT DISTINCT id, unnest(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-14', INTERVAL 1 DAY)) AS time FROM traj",
    ),
    "lambda_windows": f"WITH {_TRAJ}, {_WINDOWS} SELECT CAST(p AS BIGINT) AS p, {_T('p_start')} AS p_start, {_T('p_end')} AS p_end FROM wins",
    "segment_partition_join": f"WITH {_TRAJ}, {_SEGS}, {_WINDOWS} SELECT id, {_T('t0')} AS t0, CAST(p AS BIGINT) AS p FROM segs JOIN wins ON t1 >= p_start AND t0 <= p_end",
    "point_segment_distance": f"""WITH {_TRAJ}, {_PAIRS} SELECT id, {_T('t0')} AS t0, round({_ps('nx0', 'ny0', *_A)}, 6) AS d,
          round(CASE WHEN {_hyp(*_A)} = 0 THEN {_hyp('nx0', 'ny0', 'x0', 'y0')} ELSE abs((x1 - x0) * (y0 - ny0) - (x0 - nx0) * (y1 - y0)) / {_hyp(*_A)} END, 6) AS d_line FROM pairs""",
    "segments_intersect": f"WITH {_TRAJ}, {_PAIRS} SELECT id, {_T('t0')} AS t0, ({_meets(_A, _B)}) AS meets FROM pairs",
    "segment_distance": f"WITH {_TRAJ}, {_PAIRS} SELECT id, {_T('t0')} AS t0, round({_ss(_A, _B)}, 6) AS d FROM pairs",
    "segment_pair_edges_endpoint": f"""WITH {_TRAJ}, {_SEGS} SELECT DISTINCT {_T('a.t0')} AS t0, a.id AS a, b.id AS b
        FROM segs a JOIN segs b ON a.t0 = b.t0 AND a.id < b.id WHERE {_ss(_ENDS_A, _ENDS_B)} <= {EPS}""",
    "fixed_windows": f"WITH {_TRAJ}, {_FIXED} SELECT p, {_T('p_start')} AS p_start, {_T('p_end')} AS p_end FROM fixed",
    "segment_edges_ends": f"""WITH {_TRAJ}, {_PARTS} SELECT a.p, a.seg AS a, b.seg AS b FROM parts a JOIN parts b ON a.p = b.p AND a.seg < b.seg
        WHERE least({_hyp('a.x0', 'a.y0', 'b.x0', 'b.y0')}, {_hyp('a.x0', 'a.y0', 'b.x1', 'b.y1')}, {_hyp('a.x1', 'a.y1', 'b.x0', 'b.y0')}, {_hyp('a.x1', 'a.y1', 'b.x1', 'b.y1')}) <= {EPS}""",
    "segment_edges_exact": f"WITH {_TRAJ}, {_PARTS} SELECT a.p, a.seg AS a, b.seg AS b FROM parts a JOIN parts b ON a.p = b.p AND a.seg < b.seg AND a.t0 <= b.t1 AND a.t1 >= b.t0 WHERE {_ss(tuple('a.' + c for c in _A), tuple('b.' + c for c in _A))} <= {EPS}",
    "eps_neighbor_pairs": f"WITH {_TRAJ}, {_EDGES} SELECT {_T('time')} AS time, a, b FROM edges",
    "eps_neighbor_pairs_haversine": f"WITH {_TRAJ}, g AS ({GEO_SQL}) SELECT {_T('a.time')} AS time, a.id AS a, b.id AS b FROM g a JOIN g b ON a.time = b.time AND a.id < b.id WHERE {_HAV.format(x0='a.x', y0='a.y', x1='b.x', y1='b.y')} <= {EPS}",
    "dbscan_core_border": f"{_REC}{_CLUSTERS} SELECT {_T('time')} AS time, id, neighbours, neighbours >= {M} AS core FROM deg",
    "snapshot_clusters": f"{_REC}{_CLUSTERS} SELECT {_T('time')} AS time, label, id FROM members",
    "cmc_convoys": f"{_REC}{_CLUSTERS}, {_FOLD} SELECT objects, {_T('s')} AS start_time, {_T('e')} AS end_time, l AS lifetime_points FROM convoys",
    "convoy_summary_numbered": f"{_REC}{_CLUSTERS}, {_FOLD}, {_CONVOY_NO} SELECT convoy_id, len(o) AS object_count, objects, {_T('s')} AS start_time, {_T('e')} AS end_time, l AS lifetime_points, l * 10 AS lifetime_minutes FROM no",
    "convoy_routes": f"{_REC}{_CLUSTERS}, {_FOLD}, {_CONVOY_NO}, {_ROUTES} SELECT convoy_id, id, {_T('time')} AS time, x, y FROM routes",
    "convoy_centroids": f"{_REC}{_CLUSTERS}, {_FOLD}, {_CONVOY_NO}, {_ROUTES} SELECT convoy_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS n_points FROM routes GROUP BY convoy_id",
    "recurrent_clusters_rci": f"{_REC}{_CLUSTERS}, {_NUMBERED}, {_SHARED} SELECT earlier, later, shared FROM shared WHERE shared >= 3",
    "tau_sweep": f"{_REC}{_taus()}",
    "cmc_convoys_haversine": f"""{_REC}g AS ({GEO_SQL}), edges AS (SELECT a.time, a.id AS a, b.id AS b FROM g a JOIN g b ON a.time = b.time AND a.id < b.id
          AND {_HAV.format(x0='a.x', y0='a.y', x1='b.x', y1='b.y')} <= {EPS}), {_clusters('edges')}, {_FOLD} SELECT {_SHOWN} FROM convoys""",
    "segment_distance_variants": f"""WITH {_TRAJ}, {_PAIRS} SELECT id, {_T('t0')} AS t0,
          round(least({_hyp('x0', 'y0', 'nx0', 'ny0')}, {_hyp('x0', 'y0', 'nx1', 'ny1')}, {_hyp('x1', 'y1', 'nx0', 'ny0')}, {_hyp('x1', 'y1', 'nx1', 'ny1')}), 6) AS d_ends,
          round(least({_ps(*_A[:2], *_B)}, {_ps(*_A[2:], *_B)}, {_ps(*_B[:2], *_A)}, {_ps(*_B[2:], *_A)}), 6) AS d_clamped FROM pairs""",
    "equirectangular_xy": f"""WITH {_TRAJ}, g AS ({GEO_SQL}) SELECT id, {_T('time')} AS time, round(6371000.0::DOUBLE * radians(x) * cos(radians(39.9::DOUBLE)), 3) AS x,
          round(6371000.0::DOUBLE * radians(y), 3) AS y, round((x - 116.4::DOUBLE) * 111000.0, 3) AS rough_x FROM g""",
    "map_centre_point": f"WITH {_TRAJ}, g AS ({GEO_SQL}) SELECT round(coalesce(avg(y), {CENTRE[0]}), 9) AS lat, round(coalesce(avg(x), {CENTRE[1]}), 9) AS lon FROM g",
    "first_objects": f"WITH {_TRAJ}, {_ORDER} SELECT id, {_T('time')} AS time, x, y FROM traj WHERE id IN (SELECT id FROM nth_of WHERE nth < 20)",
    "nth_object": f"WITH {_TRAJ}, {_ORDER} SELECT id, {_T('time')} AS time, x, y FROM traj WHERE id IN (SELECT id FROM nth_of WHERE nth = 3)",
    "laid_convoy_routes": f"""{_REC}{_CLUSTERS}, {_FOLD}, {_CONVOY_NO}, spans_of AS (SELECT convoy_id, s, e, unnest(o) AS id FROM no),
        reach_of AS (SELECT c.convoy_id, c.id, c.s, c.e, max(t.time) FILTER (t.time < c.s) AS b, min(t.time) FILTER (t.time > c.e) AS a FROM spans_of c JOIN traj t ON t.id = c.id GROUP BY ALL),
        known AS (SELECT r.convoy_id, t.id, t.time, t.x, t.y FROM reach_of r JOIN traj t ON t.id = r.id AND (t.time BETWEEN r.s AND r.e OR t.time = r.b OR t.time = r.a)),
        grid AS (SELECT convoy_id, id, unnest(generate_series(s, e, INTERVAL 12 HOURS)) AS time FROM spans_of), {_between('convoy_id, id')}
        SELECT convoy_id, id, {_T('time')} AS time, round(x, 6) AS x, round(y, 6) AS y FROM laid""",
    "stay_points": f"{_REC}{_STAYS} SELECT id, {_T('time')} AS time, x, y FROM moving",
    "dp_keep_points": f"{_REC}{_SIMPLE} SELECT id, {_T('time')} AS time, x, y FROM kept",
    "dp_line_variant": f"{_REC}{_dp(True)} SELECT id, {_T('time')} AS time, x, y FROM kept",
    "dp_segments_tolerance": f"{_REC}{_SIMPLE} SELECT id, {_T('t0')} AS t0, {_T('t1')} AS t1, round(tolerance, 6) AS tolerance FROM dsegs",
    "dp_reduction_stats": f"""{_REC}{_SIMPLE}, c AS (SELECT (SELECT count(*) FROM pts) AS n_points, (SELECT count(*) FROM kept) AS n_kept)
        SELECT n_points, n_kept, round(100.0::DOUBLE * (1 - n_kept / n_points), 6) AS reduction_percent FROM c""",
    "traj_pair_edges": f"{_REC}{_TPAIRS} SELECT CAST(time AS BIGINT) AS p, a, b FROM tedges",
    "traj_pair_edges_pruned": f"{_REC}{_TPAIRS} SELECT CAST(time AS BIGINT) AS p, a, b FROM tedges",
    "traj_clusters": f"{_REC}{_TCLUSTERS} SELECT CAST(time AS BIGINT) AS p, label, id FROM members_t",
    "cuts_candidates": f"{_REC}{_CANDIDATES} SELECT {_SHOWN} FROM cands",
    "cuts_convoys": f"{_REC}{_REFINED} SELECT {_SHOWN} FROM refined",
    "cuts_filter_log": f"""{_REC}{_CANDIDATES}
        SELECT CAST(w.p AS BIGINT) AS p, {_T('w.p_start')} AS p_start, {_T('w.p_end')} AS p_end, (SELECT count(DISTINCT id) FROM tparts q WHERE q.p = w.p) AS objects_in_partition,
          (SELECT count(DISTINCT label) FROM members_t q WHERE q.time = w.p) AS filter_clusters, len(f.act) AS active_candidates
        FROM wins w JOIN wsteps st ON st.s = w.p_start JOIN fold_w f ON f.n = st.n""",
    "cmc_vs_cuts_coverage": f"""{_REC}{_CLUSTERS}, {_FOLD}, {_CANDIDATES}, held AS (
          SELECT EXISTS (SELECT 1 FROM cands c WHERE c.s <= v.e AND c.e >= v.s AND len(list_intersect(v.o, c.o)) = len(v.o)) AS covered FROM convoys v)
        SELECT covered, count(*) AS n_convoys FROM held GROUP BY covered""",
    "cuts_minutes_candidates": f"{_REC}{_MINUTES_FOUND} SELECT {_SHOWN} FROM convoys_m",
    "cuts_minutes_convoys": f"{_REC}{_MINUTES_REFINED} SELECT objects, {_T('s')} AS start_time, {_T('e')} AS end_time, max(l) AS lifetime_points FROM convoys_o GROUP BY objects, s, e",
    "cluster_bbox_overlap": f"{_REC}{_CLUSTERS}, {_NUMBERED}, {_BOXES} SELECT earlier, later FROM meets",
    "cluster_hausdorff": f"""{_REC}{_CLUSTERS}, {_NUMBERED}, {_BOXES}, d AS (SELECT m.earlier, m.later, a.id AS ai, b.id AS bi, {_hyp('a.x', 'a.y', 'b.x', 'b.y')} AS d FROM meets m JOIN spots a ON a.seq = m.earlier JOIN spots b ON b.seq = m.later)
        SELECT earlier, later, round(max(d), 6) AS hausdorff FROM (SELECT earlier, later, min(d) AS d FROM d GROUP BY earlier, later, ai UNION ALL SELECT earlier, later, min(d) FROM d GROUP BY earlier, later, bi) GROUP BY earlier, later""",
    "parse_object_ids": """WITH m AS (SELECT event_id, regexp_extract_all('{np.int64( ' || user_id || ' ' || props || ' ), 7}', '([-+]?[0-9]+)', 1) AS l FROM events),
        u AS (SELECT event_id, CAST(unnest(l) AS BIGINT) AS v, unnest(range(len(l))) AS i FROM m), f AS (SELECT event_id, v, min(i) AS i FROM u GROUP BY event_id, v)
        SELECT event_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY i) AS ids FROM f GROUP BY event_id""",
}
