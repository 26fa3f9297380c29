"""Readers and writers of location points and convoys; schemas are declared, never inferred."""

from __future__ import annotations

import json
from functools import reduce
from html import escape

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import joined, object_ids

POINT = "id long, time timestamp, x double, y double"


class MissingInput(FileNotFoundError):
    """The input path doesn't exist."""


def _read(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    try:
        return spark.read.schema(schema).options(timestampFormat="yyyy-MM-dd HH:mm:ss", **options).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise MissingInput(path) from e
        raise


def read_raw(spark: SparkSession, directory: str, pattern: str = "*.txt") -> DataFrame:
    """Headerless logs of a directory, one file per object."""
    return _read(spark, directory, POINT, pathGlobFilter=pattern)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Processed points with a header."""
    return require(_read(spark, path, POINT, header=True), "id", "time", "x", "y")


def read_first(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """The first ``rows`` rows of a headerless log, a report of that many: by file and place in it; minute-rounded time and radians."""
    from ..functions.values import round_time

    raw = _read(spark, path, "taxi_id long, date_time timestamp, longitude double, latitude double")
    at = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    first = at.orderBy("__file", "__block", "__row").limit(rows).drop("__file", "__block", "__row")
    return first.withColumns({"timestamp": round_time(F.col("date_time"), 1), "lat_rad": F.radians("latitude"), "lon_rad": F.radians("longitude")})


def require(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_convoys(spark: SparkSession, path: str) -> DataFrame:
    """Saved convoys: rows without ids are left out, and the ordinal of the rest is the id where there is none."""
    raw = require(spark.read.option("header", True).csv(path), "objects", "start_time", "end_time")
    rows = raw.withColumn("ids", object_ids(F.col("objects"))).where(F.size("ids") > 0)
    nth = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # saved results: few rows
    own = F.col("convoy_id").cast("long") if "convoy_id" in raw.columns else F.lit(None).cast("long")
    return rows.withColumn("nth", nth).select(F.coalesce(own, "nth").alias("convoy_id"), F.col("ids").alias("objects"), F.to_timestamp("start_time").alias("start_time"), F.to_timestamp("end_time").alias("end_time"))


def write_points(df: DataFrame, path: str) -> None:
    df.select("id", "time", "x", "y").write.mode("overwrite").csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")


def write_convoys(convoys: DataFrame, path: str) -> None:
    convoys.withColumn("objects", joined(F.col("objects"))).write.mode("overwrite").csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")


def numbered(convoys: DataFrame, point_minutes: int = 10) -> DataFrame:
    """Convoys in order of start, then falling size, with a number, their ids as text, and their minutes at so many a point."""
    order = Window.orderBy("start_time", F.desc(F.size("objects")), joined(F.col("objects")), "end_time")
    return convoys.select(
        F.row_number().over(order).alias("convoy_id"), F.size("objects").alias("object_count"), joined(F.col("objects")).alias("objects"),
        "start_time", "end_time", "lifetime_points", (F.col("lifetime_points") * point_minutes).alias("lifetime_minutes"),
    )


def routes(points: DataFrame, convoys: DataFrame) -> DataFrame:
    """The points of each convoy's objects during the convoy, one row each."""
    members = convoys.select("convoy_id", "start_time", "end_time", F.explode("objects").alias("id"))
    return members.join(points, "id").where(F.col("time").between(F.col("start_time"), F.col("end_time"))).select("convoy_id", "id", "time", "x", "y")


def centroids(points: DataFrame, convoys: DataFrame) -> DataFrame:
    return routes(points, convoys).groupBy("convoy_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n_points"))


#: Colours of the convoys on a map, in turn: evenly spaced hues.
COLOURS = tuple(f"hsl({round(360 * k / 12)} 70% 40%)" for k in range(12))
#: Fixed value: the map's centre (latitude, longitude) if there are no points.
CENTRE = (39.9, 116.4)


def map_centre(points: DataFrame) -> DataFrame:
    return points.agg(F.coalesce(F.avg("y"), F.lit(CENTRE[0])).alias("lat"), F.coalesce(F.avg("x"), F.lit(CENTRE[1])).alias("lon"))


def geojson(route_rows: DataFrame, key: str = "convoy_id") -> DataFrame:
    """One GeoJSON feature per route with at least two points, made on the executors."""
    line = route_rows.groupBy(key, "id").agg(F.sort_array(F.collect_list(F.struct("time", "x", "y"))).alias("p")).where(F.size("p") > 1)
    colour = F.element_at(F.array(*map(F.lit, COLOURS)), (F.pmod(F.col(key), F.lit(len(COLOURS))) + 1).cast("int"))
    shape = F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda q: F.array(q["x"], q["y"])).alias("coordinates"))
    return line.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col(key).alias("group"), F.col("id"), colour.alias("colour")).alias("properties"), shape.alias("geometry"))).alias("feature"))


def write_map(route_rows: DataFrame, path: str, title: str = "Convoys") -> None:
    """A self-contained page of all routes: a layer per group that can be switched, a dot at a route's start and a flag at its end."""
    _page([("", route_rows, "")], path, title)


def write_simplified_map(points: DataFrame, simplified: DataFrame, path: str, title: str = "Original and simplified") -> None:
    """Original routes dashed, simplified ones (``kept`` rows) solid, a layer for each object and form."""
    rows = lambda df: df.select(F.col("id").alias("convoy_id"), "id", "time", "x", "y")
    _page([("original ", rows(points), 'stroke-dasharray="4 3" '), ("simplified ", rows(simplified.where("kept")), "")], path, title)


def write_trajectory_map(points: DataFrame, path: str, title: str = "Trajectories") -> None:
    """A layer for each object."""
    write_map(points.select(F.col("id").alias("convoy_id"), "id", "time", "x", "y"), path, title)


def laid_routes(points: DataFrame, convoys: DataFrame, step: str = "10 minutes") -> DataFrame:
    """Routes of saved convoys (as :func:`read_convoys` gives them), interpolated on each one's own grid of times."""
    from ..operators.windows import interpolate

    spans = convoys.select(F.col("convoy_id").alias("track"), F.explode("objects").alias("id"), "start_time", "end_time")
    return interpolate(points, spans, step, reach_out=True).withColumnRenamed("track", "convoy_id")


def thin_routes(route_rows: DataFrame, convoys: DataFrame) -> DataFrame:
    """``convoy_id, id, n_points`` of the objects that a map can't draw: those with fewer than two points."""
    wanted = convoys.select("convoy_id", F.explode("objects").alias("id"))
    counts = route_rows.groupBy("convoy_id", "id").agg(F.count(F.lit(1)).alias("n_points"))
    return wanted.join(counts, ["convoy_id", "id"], "left").withColumn("n_points", F.coalesce("n_points", F.lit(0))).where("n_points < 2")


def _page(layers: list[tuple[str, DataFrame, str]], path: str, title: str) -> None:
    """Routes one after another, so the driver holds one partition's at a time; (name before the group, routes, SVG attributes)."""
    every = reduce(DataFrame.unionByName, (rows.select("convoy_id", "id", "x", "y") for _, rows, _ in layers))
    spans = every.groupBy("convoy_id", "id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))
    x0, x1, y0, y1 = spans.where("n > 1").agg(F.min("x0"), F.max("x1"), F.min("y0"), F.max("y1")).first()
    place = lambda p: ((p[0] - x0) / ((x1 - x0) or 1) * 960 + 20, (y1 - p[1]) / ((y1 - y0) or 1) * 560 + 20)
    script = (
        "const names=[...new Set([...document.querySelectorAll('g[data-layer]')].map(g=>g.dataset.layer))];"
        "for(const n of names){const l=document.createElement('label'),c=document.createElement('input');c.type='checkbox';c.checked=true;"
        "c.onchange=()=>document.querySelectorAll('g[data-layer]').forEach(g=>{if(g.dataset.layer===n)g.style.display=c.checked?'':'none'});"
        "l.append(c,n);document.body.append(l)}"
    )
    with open(path, "w") as out:
        out.write(f'<!doctype html><title>{escape(title)}</title><h1>{escape(title)}</h1><svg viewBox="0 0 1000 600">')
        for name, rows, style in layers:
            for r in geojson(rows).toLocalIterator():
                f = json.loads(r["feature"])
                own, spots = f["properties"], [place(p) for p in f["geometry"]["coordinates"]]
                line = " ".join(f"{x:.1f},{y:.1f}" for x, y in spots)
                (ax, ay), (bx, by) = spots[0], spots[-1]
                out.write(f'<g data-layer="{name}{own["group"]}" stroke="{own["colour"]}" fill="none"><title>{own["group"]}: {own["id"]}</title><polyline {style}points="{line}"/>')
                out.write(f'<circle cx="{ax:.1f}" cy="{ay:.1f}" r="3" fill="{own["colour"]}"/><path d="M{bx:.1f} {by:.1f}v-9l7 3l-7 3"/></g>')
        out.write(f"</svg><script>{script}</script>")


def events_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories derived from the events table: one point per user and day."""
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("wayfold_events")
    return spark.sql(FIXTURE_SQL.format(events="wayfold_events"))


FIXTURE_SQL = """
SELECT user_id AS id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS time, (user_id % 5) * 400.0 + value AS x,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS rn FROM {events}) e
WHERE rn = 1
"""
