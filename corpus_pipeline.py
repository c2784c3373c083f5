"""The corpus pipeline: language ID, exact dedup, near-dedup, secret redaction and packing, one written table after the other.

Every stage takes all rows of its predecessor, whatever further columns they have, and works on whole texts; an empty
table stays empty through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from kinfold.llm.common import cut, drop_table

#: Documents whose language is less sure than this (or has no letter to tell it by) go.
LEAST_SURE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter (null and empty ones too) or with no sure language go. Ties share a score."""
    model = language_id.fit(docs, "doc_id", "text", "lang")
    return language_id.keep_determined(docs, model, "text", LEAST_SURE)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that with the least id; of rows that repeat it just one; a null id stays only where there is no other."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group; rows with a null id or without words are in no group and stay."""
    return near_dedup.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets in their texts masked; null and empty texts as they are."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts and their places; null and empty texts are the end id alone, repeated rows have places of their own."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Models, shingle sets and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents that pass all stages; a stage's input is deleted once its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
