"""One query for each corpus operator, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import bpe, decontaminate, language_id, licenses, pii, pivot_topk, quality, simhash_dedup, substring_dedup, token_counts
from freshet.llm.common import read_table


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pivot_topk.whole_vectors(read_table(spark, sf_dir, "embeddings"))
    return pivot_topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return licenses.scan(docs.withColumn("path", licenses.corpus_path(F.col("doc_id"), F.col("source"))))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.replay(spark, read_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_components(read_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pivot_topk, op2_quality, op3_decontamination, op4_licenses, op5_bpe, op6_token_counts, op7_language_id, op8_simhash_dedup, op9_pii, op10_substring_dedup)}

ORACLE_SQL: dict[str, str] = {"op4_licenses": licenses.ORACLE}
