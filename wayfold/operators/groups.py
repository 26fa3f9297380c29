"""Grouped Python functions on as many tasks as the session has shuffle partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.group import GroupedData


def grouped(df: DataFrame, *keys: str) -> GroupedData:
    """``df.groupBy(keys)`` for a function that costs far more than its bytes tell.

    Adaptive execution joins small partitions by their bytes and would leave such a function one task; a repartition by number is kept,
    and the grouping needs no further exchange.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys)
