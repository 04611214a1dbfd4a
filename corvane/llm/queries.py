"""The registered query of each operator, with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.substring_dedup import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents"), with_text=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.language_id import fit, predict
    from corvane.llm.textkit import crc_remainder

    docs = _table(spark, sf_dir, "documents").withColumn("held_out", crc_remainder(F.col("doc_id"), 4) == 2)
    return predict(docs, fit(docs.where("not held_out")), columns=["doc_id", "held_out"])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), with_text=False).drop("failed")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.lm_scoring import lm_scores
    from corvane.llm.textkit import crc_remainder

    return lm_scores(_table(spark, sf_dir, "documents"), crc_remainder(F.col("doc_id"), 5) == 1)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.decontaminate import decontaminate

    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.textkit import shared_path
    from corvane.llm.token_output import read_token_ids, write_token_ids

    path = shared_path(spark, "token-ids")
    write_token_ids(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_ids(spark, path, with_ids=False)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.license_scan import license_scan

    found = license_scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("bigint").alias("n_sentences"), "n_rules", F.array_join("licences", ",").alias("licences"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.byte_bpe import byte_bpe

    return byte_bpe(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.url_filter import url_filter

    return url_filter(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.lexical_search import lexical_index, lexical_search

    return lexical_search(lexical_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.quality_classifier import quality_scores
    from corvane.llm.textkit import crc_remainder

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), crc_remainder(F.col("doc_id"), 5) == 0)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.token_alignment import token_alignment

    return token_alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), with_groups=False)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_language_id, op3_quality_rules, op4_lm_scoring, op5_simhash, op6_decontaminate, op7_token_output, op8_license_scan, op9_byte_bpe, op10_url_filter, op11_lexical_search, op12_quality_classifier, op13_token_alignment)}
