"""Bounded samples of labelled rows, for fitting models on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")), F.lit(modulus))


def texts_of(docs: DataFrame, ids: list[int], id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> pa.Table:
    """The rows of a bounded list of ids, by id, one row each: of rows with equal ids the one with the least text."""
    rows = docs.where(F.col(id_col).isin(ids) if ids else F.lit(False)).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)
    return rows.groupBy("doc_id").agg(F.min(F.struct("text", *more)).alias("row")).select("doc_id", "row.*").toArrow().sort_by("doc_id")


def labelled(docs: DataFrame, labels: DataFrame, columns: list[str], where, limit: int) -> tuple[pa.Table, dict[int, tuple]]:
    """Texts and labels of at most ``limit`` labelled documents for which ``where`` holds, taken by an id hash.

    Rows with a null id or a null label are left out; of repeated labels of an id the largest counts.
    """
    top = (
        labels.where(F.col("doc_id").isNotNull() & where).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(c).cast("int").alias(c) for c in columns))
        .dropna().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    )
    known = {r["doc_id"]: tuple(r[c] for c in columns) for r in top}
    return texts_of(docs, list(known)), known
