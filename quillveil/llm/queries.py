"""The registered queries of this subpackage; each reads its whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_bucket, shared_dir, table


def op1_embedding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cover_tree import embedding_groups

    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).drop("kept")


def token_rows(docs: DataFrame) -> DataFrame:
    from .token_files import crc_of_ids, read_token_files, write_token_files

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))  # tables written on the way are gone
    return read_token_files(spark, path, crc_of_ids, "ids_crc32")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("source", "copies")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_rules import judge

    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    bucket = id_bucket("doc_id", 4)
    found = identify(docs.select("doc_id", "text"), fit(docs, F.coalesce(bucket != 2, F.lit(False))))
    return found.select("doc_id", F.coalesce(bucket == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op7_ngram_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_groups

    return ngram_groups(table(spark, sf_dir, "documents"), size=3, percent=90)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import overlaps

    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_score

    return lm_score(table(spark, sf_dir, "documents"), id_bucket("doc_id", 10) == 0)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import periodic_runs, planted, run_digest

    return run_digest(periodic_runs(planted(table(spark, sf_dir, "documents"))))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import prefix_counts, within_budget

    return within_budget(prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), 512)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_embedding_groups, op2_line_dedup, op3_token_files, op4_mix_sources, op5_url_rules, op6_language_id, op7_ngram_groups, op8_decontamination, op9_lm_score, op10_substring_dedup, op11_hard_negatives, op12_periodic_runs, op13_token_counts, pipeline)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return {k: v for k, v in ORACLES.items() if k in queries()}
