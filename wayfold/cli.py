"""Command line: a full run over a file of processed points, and the map of saved convoys."""

from __future__ import annotations

import argparse
import logging
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .operators.preprocess import day_window, distinct_points, local_projection
from .plans.convoys import cmc, cuts_filter, filter_log, refine
from .sources.points import laid_routes, numbered, read_convoys, read_points, routes, thin_routes, write_map

log = logging.getLogger("wayfold")


@contextmanager
def timed(name: str, seconds: dict[str, float]):
    """The seconds of a stage, kept and logged."""
    began = time.time()
    yield
    seconds[name] = time.time() - began
    log.info("%-20s %9.3f s", name, seconds[name])


def saved(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")


def run(
    spark: SparkSession, points: str, prefix: str, day: str | None = None, start: str = "13:00", hours: int = 5, method: str = "cuts",
    epsilon: float = 100.0, min_objects: int = 3, min_lifetime_points: int = 3, delta: float = 100.0, lambda_points: int = 3,
) -> dict[str, float]:
    """Convoys of a day's hours, with ``PREFIX-convoys``, ``-filter-log`` (of the filter) and ``-map.html``; the seconds of each stage."""
    seconds: dict[str, float] = {}
    hour, minute = (int(x) for x in start.split(":"))
    with timed("load", seconds):
        raw = distinct_points(day_window(read_points(spark, points), day, hour, hours, minute)).cache()
        log.info("%d points of %d objects", raw.count(), raw.select("id").distinct().count())
        flat = local_projection(raw).cache()
    if method == "cmc":
        with timed("cmc", seconds):
            found = numbered(cmc(flat, min_objects, min_lifetime_points, epsilon)).cache()
            found.count()
    else:
        with timed("filter", seconds):
            candidates = cuts_filter(flat, min_objects, min_lifetime_points, epsilon, delta, lambda_points, 4 * epsilon).cache()
            log.info("%d candidates", candidates.count())
        with timed("filter log", seconds):
            saved(filter_log(flat, min_objects, min_lifetime_points, epsilon, delta, lambda_points, 4 * epsilon), f"{prefix}-filter-log")
        with timed("refinement", seconds):
            found = numbered(refine(flat, candidates, min_objects, min_lifetime_points, epsilon)).cache()
            found.count()
    with timed("save", seconds):
        saved(found, f"{prefix}-convoys")
    with timed("map", seconds):
        write_map(routes(raw, read_convoys(spark, f"{prefix}-convoys")), f"{prefix}-map.html")
    saved(spark.createDataFrame(list(seconds.items()), "stage string, seconds double").coalesce(1), f"{prefix}-seconds")
    return seconds


def show(spark: SparkSession, points: str, convoys: str, out: str, step: str = "10 minutes", title: str = "Convoys") -> int:
    """The map of saved convoys, on routes laid on each one's grid; logs and counts the objects that can't be drawn."""
    kept = read_convoys(spark, convoys)
    laid = laid_routes(read_points(spark, points), kept, step).cache()
    thin = thin_routes(laid, kept)
    for r in thin.orderBy("convoy_id", "id").limit(25).collect():  # the first 25, as a report
        log.warning("convoy %s: object %s has %d points", r["convoy_id"], r["id"], r["n_points"])
    write_map(laid, out, title)
    return thin.count()


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--log", help="a file that gets the log as well")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("run", help="find convoys")
    a.add_argument("points")
    a.add_argument("--output-prefix", default="wayfold")
    a.add_argument("--method", choices=("cmc", "cuts"), default="cuts")
    a.add_argument("--day")
    a.add_argument("--start", default="13:00")
    a.add_argument("--hours", type=int, default=5)
    a.add_argument("--epsilon", type=float, default=100.0)
    a.add_argument("--min-objects", type=int, default=3)
    a.add_argument("--min-lifetime-points", type=int, default=3)
    a.add_argument("--delta", type=float, default=100.0)
    a.add_argument("--lambda-points", type=int, default=3)
    b = sub.add_parser("map", help="draw saved convoys")
    b.add_argument("points")
    b.add_argument("convoys")
    b.add_argument("out")
    b.add_argument("--step", default="10 minutes")
    b.add_argument("--title", default="Convoys")
    o = p.parse_args(argv)
    handlers = [logging.StreamHandler()] + ([logging.FileHandler(o.log)] if o.log else [])
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
    log.handlers, log.propagate = handlers, False
    log.setLevel(logging.INFO)
    spark = SparkSession.builder.appName("wayfold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if o.command == "map":
        show(spark, o.points, o.convoys, o.out, o.step, o.title)
        return
    run(spark, o.points, o.output_prefix, o.day, o.start, o.hours, o.method, o.epsilon, o.min_objects, o.min_lifetime_points, o.delta, o.lambda_points)


if __name__ == "__main__":
    main()
