"""Exact dedup by content sort: range partitions of the text itself, neighbours compared in full."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: A text is hot when its copies would fill over 1 / HOT_PARTS of one shuffle partition, by rows or by bytes.
HOT_PARTS = 2
#: Characters of the text by which it is first sorted and parted.
LEAD = 32


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise=None) -> DataFrame:
    """Group rows whose normalised texts are equal byte for byte.

    Sampled splitters range-partition the text's first LEAD characters, a hash of it (and a salt, which is 0 but for hot
    texts); Spark's external sort by these and by the whole text places equal texts next to each other, and the window
    compares each with its neighbour in full.  The
    copies of a hot text are dealt over as many salts as there are shuffle partitions and their few partial
    counts are joined by digest, so no task holds a whole hot group.

    Returns ``id_col, keep_id, group_size, kept, text_sha256``, one row per input row.  Null texts count as
    empty; ``normalise`` maps a Column to a Column (default: no change).  ``keep`` is "max" or "min": of equal
    texts the row with that id stays.  Rows repeated with the same id are all marked kept if their id stays.
    A null id never wins over another id; a group of null ids alone has keep_id null and keeps all rows.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    best = {"max": F.max, "min": F.min}[keep]
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text: Column = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (normalise(text) if normalise else text).alias("t"))
    hot = _hot(rows, parts)
    # Splitters are sampled from the first characters, a hash and the salt: what the sample brings to the driver doesn't grow with the texts.
    keyed = rows.withColumns({"lead": F.substring("t", 1, LEAD), "h": F.xxhash64("t")})
    salted = ["lead", "h"]
    if hot:
        keyed = keyed.withColumn("salt", F.when(F.col("h").isin(hot), F.pmod(F.monotonically_increasing_id(), F.lit(parts))).otherwise(F.lit(0)).cast("int"))
        salted.append("salt")
    sorted_rows = keyed.repartitionByRange(*salted)
    same = Window.partitionBy(*salted, "t")  # met by the range partitions: no second exchange
    marked = sorted_rows.select(
        "id", F.sha2(F.col("t").cast("binary"), 256).alias("sha"), *salted[1:],
        best("id").over(same).alias("top"), F.count(F.lit(1)).over(same).alias("n"),
    )
    if hot:
        # The parts of hot texts: at most len(hot) * parts rows, then one row for each hot text.
        marked = written(marked, "dedup")
        whole = (
            marked.where(F.col("h").isin(hot)).groupBy("sha", "salt").agg(F.first("top").alias("top"), F.first("n").alias("n"))
            .groupBy(F.col("sha").alias("hot_sha")).agg(best("top").alias("hot_top"), F.sum("n").alias("hot_n"))
        )
        # len(hot) <= 2 * HOT_PARTS * parts by construction, 80 bytes each.
        marked = marked.join(F.broadcast(whole), F.col("sha") == F.col("hot_sha"), "left").select(
            "id", "sha", F.when(F.col("hot_n").isNull(), F.col("top")).otherwise(F.col("hot_top")).alias("top"), F.coalesce("hot_n", "n").alias("n")
        )
    return marked.select(
        F.col("id").alias(id_col), F.col("top").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
        F.coalesce(F.col("id") == F.col("top"), F.col("top").isNull()).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def _hot(rows: DataFrame, parts: int) -> list[int]:
    """Hashes of the texts with over 1 / (HOT_PARTS * parts) of all rows, or of all bytes; there are fewer than twice HOT_PARTS * parts."""
    per_text = rows.groupBy(F.xxhash64("t").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t") + F.lit(1)).alias("b"))
    total, size = rows.select(F.count(F.lit(1)), F.sum(F.octet_length("t") + F.lit(1))).first()
    least = 1 / (HOT_PARTS * parts)
    share = F.greatest(F.col("n") / max(total, 1), F.col("b") / max(size or 0, 1))
    top = per_text.where((F.col("n") > 1) & (share > least)).orderBy(F.desc("n"), "h").limit(2 * HOT_PARTS * parts)  # no more than that can be
    return [r["h"] for r in top.collect()]
