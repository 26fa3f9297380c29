"""Lineage cuts in the folder that the cluster shares."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a session on this machine alone gets a temporary folder; on a cluster there is none that all executors
    see, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="wayfold-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lineage cut that outlives executors.

    ``paths`` gets the table's path, for :func:`dropped`.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that no result reads any more, by Spark's own file system for their paths."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


def in_written_order(table: DataFrame, name: str) -> DataFrame:
    """The rows of a written table and, as ``name``, their places from 0 in the order of the partitions that were written.

    A scan lists files by size, so a reread keeps no order.  The partitions' numbers are in the names of the part files, and the
    rows of a file are in order.  ``table`` is read from the files that one write left.
    """
    at = table.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    rows = at.groupBy("__file").count().collect()  # a row for each file
    start, starts = 0, []
    for r in sorted(rows, key=lambda r: tuple(map(int, re.fullmatch(r"part-(\d+)-.*-c(\d+)[^-]*", r["__file"]).groups()))):
        starts.append((r["__file"], start))
        start += r["count"]
    known = table.sparkSession.createDataFrame(starts, "__name string, __start long")
    placed = at.join(F.broadcast(known), F.col("__file") == F.col("__name"))
    return placed.select(*[table[c] for c in table.columns], (F.col("__start") + F.col("__row")).alias(name))


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that nothing refers to any more: its cleaner waits for the driver's garbage collections."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
