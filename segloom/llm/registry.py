"""The dealt operators as queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segloom.llm import decontamination, imatch, language_id, lm_scoring, mixing, quality, sharding, simhash, substring_dedup, token_counts
from segloom.llm.common import crc_part, table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_scoring.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), crc_part("doc_id", 5) == 1)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, expected_grade, tail_prob, keep for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.grades_of(table(spark, sf_dir, "labels")))
    graded = quality.with_grades(docs, model)
    return graded.select("doc_id", "expected_grade", "tail_prob", (graded.tail_prob >= model.keep).alias("keep"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.repeats(table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"), crc_part("doc_id", 4) == 2)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.digest(imatch.fingerprints(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_sharding": op4_sharding,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_mixing": op8_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_imatch": op10_imatch,
}
ORACLES: dict[str, str] = {
    "op2_decontamination": decontamination.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op8_mixing": mixing.ORACLE,
}
