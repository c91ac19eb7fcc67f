"""The corpus pipeline: quality rules, near-duplicates, decontamination, pseudonyms, token ids.

Every stage takes (spark, docs, sf_dir), where docs has the columns of the documents
table, and works on all rows that the stage before it kept. Side tables (labels,
benchmark) are read from sf_dir whole. Null texts and doc_ids, repeated rows, very long
texts and extra columns are taken as the operators' docstrings say; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm import bpe, decontaminate, neardup, pii, quality
from segmill.llm.queries import pseudonym_key
from segmill.llm.shared import stash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the least doc_id stays."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Valid personal data in the texts become format-preserving pseudonyms."""
    return pii.pseudonymise(docs, key=pseudonym_key(spark))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids; the ids decode to the text."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii_pseudonyms", pseudonyms),
    ("bpe_token_ids", token_ids),
]

#: SQL can express neither the near-duplicate components nor the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
