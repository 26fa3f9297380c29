"""Time bins, object lists and other scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_time(time: Column, minutes: int) -> Column:
    """The nearest multiple of ``minutes``; half-way times go to the even multiple."""
    step = minutes * 60
    return F.timestamp_seconds(F.bround(F.unix_micros(time.cast("timestamp")) / (step * 1_000_000)) * step)


def object_ids(text: Column) -> Column:
    """All integers of a text, each once, in the order met."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([-+]?[0-9]+)"), 1), lambda x: x.cast("long")))


def joined(objects: Column) -> Column:
    return F.array_join(F.transform(objects, lambda x: x.cast("string")), ",")


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def reduction_percent(before: Column, after: Column) -> Column:
    return 100.0 * (1 - after / F.greatest(before, F.lit(1)))


def stamp(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")
