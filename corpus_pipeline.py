"""Corpus preparation: five stages, each written as Parquet and read again.

Every stage but the last gives the rows that it keeps with all their columns. Rows with nulls are
judged like any others (a null text fails the quality rules); an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import bpe, decontamination, language, quality_rules, simhash
from wardspark.llm.common import fold, written
from wardspark.session import compute_once, tuned

POLICY = 2


def keep_good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    entries = compute_once(quality_rules.ledger(docs), ["_row"], ["failed"])
    return quality_rules.apply_policy(entries, POLICY).filter("kept").select("_row.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs.filter(fold(F.col("doc_id"), 3) != 1))
    found = language.identify(docs, model)
    # a low score alone says nothing against a text: close languages and mixed texts have one
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select("_row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = compute_once(decontamination.overlap(docs, items), ["_row"], ["n_hit"])
    return found.filter("n_hit = 0").select("_row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                       public_tokenizers.PATTERN, ["doc_id"], with_ids=True)


STAGES = [
    ("quality_rules", keep_good_texts),
    ("language_id", keep_known_languages),
    ("simhash_dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("byte_bpe", encode),
]

# Language models and merges are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of the documents that stay."""
    tuned(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
