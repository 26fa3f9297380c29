"""The corpus pipeline: documents in, token ids and their places in training order out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import byte_bpe, exact_dedup, mixing, ngram_join, toxicity
from wayfold.llm.store import in_written_order, read_table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain rejects go.

    Null and empty texts have no terms and stay, as do rows with a null id; repeated rows are judged alike; columns of any name,
    also ``toxic`` or ``p_toxic``, stay as they are; an empty table stays empty.
    """
    model = toxicity.train_on(docs, read_table(spark, sf_dir, "labels"))
    names = ["doc_id", *(c for c in docs.columns if c != "doc_id")]
    scored = toxicity.score_toxicity(docs, model, keep=tuple(names[1:]))
    scored = scored.toDF(*(f"__{i}" for i in range(len(scored.columns))))  # the verdict is the last column
    kept = scored.where(~F.col(f"__{len(scored.columns) - 1}"))
    return kept.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(names))).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one row stays: one with the smallest id; a row goes by its id and its text.

    So a row that shares its id with a copy stays if its own text does, and rows without an id go if any other row has
    their text.  Of rows with equal ids and texts the least in the order of the columns is taken.  A null text is an empty
    one.  Columns of any name stay as they are; an empty table stays empty.
    """
    marks = exact_dedup.exact_dedup(docs, keep="min").select(F.col("doc_id").alias("__id"), F.xxhash64("text_sha256").alias("__text"), "kept")
    marks = written(marks, "exact-marks")
    own = F.xxhash64(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
    if not marks.where("kept").groupBy("__id", "__text").count().where("count > 1").isEmpty():
        docs = docs.groupBy(F.col("doc_id").cast("long"), own).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    drop = marks.where("not kept")
    return docs.join(drop, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (own == F.col("__text")), "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays, one with the smallest id.

    Texts without words, null ones too, are near copies of nothing and stay.  If ids repeat or are null, rows go by their
    own text alone.  Columns of any name stay as they are; an empty table stays empty.
    """
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the curriculum takes a document, in training order.

    A null source is a source; rows without words are taken 0 times and so go; repeated rows and null ids are taken each
    for itself.  Columns of any name stay as they are; an empty table stays empty.
    """
    return mixing.curriculum(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, position`` of each row of the written mix; position is the place in training order, from 0.

    A null or empty text has no ids, a null id stays null, repeated rows have a position each; other columns, one named
    ``position`` too, are left out; an empty table gives an empty result.
    """
    rows = byte_bpe.bpe_tokens(in_written_order(docs, "__place"), public_tokenizers.path("byte_bpe_50k.tiktoken"), place_col="__place")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("__place").alias("position"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix),
    ("byte-level BPE", tokenize),
]

#: Stages hold trained models and hash orders that SQL can't state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
