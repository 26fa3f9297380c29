"""Results that are computed once and read by all that follows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a session on this machine alone gets a temporary folder where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="wayfold-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def once(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, so that no plan holds what made it.

    The exchanges of grouped Python functions are never reused within a plan: each use would compute them anew.
    """
    path = f"{shared_dir(df.sparkSession)}/tables/once-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
