"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, langid, mixing, ngram_join, quality_model, quality_rules, sharding, token_file, toxicity
from .sample import remainder
from .store import read_table

#: Shards of op7.
SHARDS = 24


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"), keep="max")


def _held_out(rows: DataFrame, modulus: int, held: int) -> DataFrame:
    return rows.withColumn("held_out", F.coalesce(remainder("doc_id", modulus) == held, F.lit(False)))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train_on(docs, remainder("doc_id", 3) != 1)
    return _held_out(langid.language_id(docs, model), 3, 1).select("doc_id", "held_out", "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train_on(docs, read_table(spark, sf_dir, "labels"))
    return _held_out(toxicity.score_toxicity(docs, model), 5, 0)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(read_table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(read_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    # A document is taken as often as the curriculum has a place for it in the training.
    placed = F.size(F.filter("positions", lambda p: p.between(0.0, 1.0)))
    return mix.select("doc_id", "size", "source_size", "target", (placed * F.col("size")).cast("long").alias("taken"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality_model.train_on(docs, read_table(spark, sf_dir, "labels"))
    return _held_out(quality_model.score_quality(docs, model), 5, 0).select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_language_id, op3_quality_rules, op4_token_file, op5_byte_bpe, op6_toxicity, op7_sharding, op8_ngram_join, op9_mixing, op10_quality_model)
}

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               coalesce(doc_id = max(doc_id) OVER same, max(doc_id) OVER same IS NULL) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    # Sets of 5-word shingles (as lists of words), pairs by common shingles, and the closure of the links.
    "op8_ngram_join": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        parts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM parts),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
                  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (min(x.n) + min(y.n) - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
    """,
    # Targets by shares in the order in which sources reach their limits; the line of each source in the order of MD5.
    "op9_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS o FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
        w AS (SELECT *, CAST([5, 2, 1][nth % 3 + 1] AS DOUBLE) AS weight FROM s),
        c AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights, coalesce(sum(source_size) OVER before, 0) AS cut_size, coalesce(sum(weight) OVER before, 0) AS cut_weight
              FROM w WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT *, weight * (total - 3.0::DOUBLE * cut_size) / (weights - cut_weight) >= 3 * source_size AS whole FROM c),
        t AS (SELECT source, source_size, CASE WHEN whole THEN CAST(3 * source_size AS DOUBLE) ELSE
                weight * (total - 3.0::DOUBLE * coalesce(sum(source_size) FILTER (whole) OVER (), 0)) / (weights - coalesce(sum(weight) FILTER (whole) OVER (), 0)) END AS target FROM f),
        l AS (SELECT d.doc_id, size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size + 1e-9) ELSE 0 END AS epochs,
                sum(size) OVER (PARTITION BY d.source ORDER BY o, d.doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS middle
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(size * CASE WHEN size = 0 THEN 0 ELSE least(epochs + CASE WHEN epochs < 3 AND middle < target - epochs * source_size THEN 1 ELSE 0 END, 3) END AS BIGINT) AS taken FROM l
    """,
}
