"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, flat, neardup, pii, quality, secrets, separators, substrings, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.strip_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_bytes")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), path="source")


def op7_warc_in_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_separator_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.counted(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in base], "kept")


def pseudonym_key(spark: SparkSession) -> str:
    """The session's key; the queries over test tables run without one too, in the open."""
    return spark.conf.get(pii.SETTING, None) or "no secret: test tables only"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=pseudonym_key(spark), count="n_replaced")


def op2_flat_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat.token_files(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_pii_pseudonyms,
        op2_flat_token_files,
        op3_benchmark_decontamination,
        op4_minhash_near_dedup,
        op5_suffix_array_dedup,
        op6_secret_scan,
        op7_warc_in_zip,
        op8_separator_token_counts,
        op9_quality_rules,
        op10_bpe_round_trip,
    )
    return {f.__name__: f for f in found}
