"""One query per operator, on the whole of its table, and the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm import (bpe, chat_format, conversation_repair, decontamination, language, licences,
                           manifest, packing, ppm, quality_model, quality_rules, simhash, token_files)
from wardspark.llm.common import fold
from wardspark.session import scratch_path, tuned

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run):
    QUERIES[run.__name__] = lambda spark, sf: run(tuned(spark), sf)
    return run


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    learned = labels.filter(fold(F.col("doc_id"), 5) != 0)
    scored = quality_model.score(docs, quality_model.train(docs, "quality", labels=learned))
    return scored.select(
        F.col("_row.doc_id").alias("doc_id"),
        (fold(F.col("_row.doc_id"), 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op2_lm_scoring(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", (fold(F.col("doc_id"), 5) != 1).alias("train"))
    scored = ppm.score(docs, ["doc_id"], "train")
    key = F.col("_key.doc_id")
    return scored.select(key.alias("doc_id"), (fold(key, 5) == 1).alias("held_out"), "n_tokens",
                         "n_known", "train_tokens", "base_score", "score")


@query
def op3_decontamination(spark, sf):
    found = decontamination.overlap(table(spark, sf, "documents").select("doc_id", "text"),
                                    table(spark, sf, "benchmark"))
    return found.select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op4_simhash_dedup(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"),
                        "component_id")


@query
def op5_byte_bpe(spark, sf):
    return bpe.digests(table(spark, sf, "documents").select("doc_id", "text"),
                       public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                       ["doc_id"])


@query
def op6_quality_rules(spark, sf):
    entries = quality_rules.ledger(table(spark, sf, "documents").select("doc_id", "text"))
    judged = quality_rules.apply_policy(entries, 2)
    return judged.select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"), "kept")


@query
def op7_token_files(spark, sf):
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf, "documents"), path,
                             public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.checksums(token_files.read_tokens(spark, path))


@query
def op8_licence_scan(spark, sf):
    found = licences.scan(table(spark, sf, "documents").select("doc_id", "text"),
                          licences.template_table(spark))
    return found.select(F.col("_row.doc_id").alias("doc_id"), "licence", "unit",
                        F.round("score", 6).alias("score"),
                        F.array_join("licences", ",").alias("licences"))


@query
def op9_chat_format(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(
        [(-7, n, role, "</s>[INST] ok [/INST]") for n, role in enumerate(("user", "assistant"))],
        rows.schema)
    turns = rows.union(planted).select(
        "conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("content"))
    parsed = chat_format.parse(chat_format.format_conversations(turns))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("learned_text").cast("long").alias("loss_chars"),
        F.sha2("learned_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query
def op10_language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.filter(fold(F.col("doc_id"), 3) != 1))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select(F.col("_row.doc_id").alias("doc_id"),
                        (fold(F.col("_row.doc_id"), 3) == 1).alias("held_out"), "lang_pred",
                        "score")


@query
def op11_packing(spark, sf):
    pieces = packing.cut(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                                       "ids_crc32", "sequence_id", "offset")


@query
def op12_conversation_repair(spark, sf):
    return conversation_repair.repair(
        conversation_repair.damaged(table(spark, sf, "conversations")))


@query
def op13_manifest(spark, sf):
    tampered = F.when(fold(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return manifest.manifest(table(spark, sf, "documents"), ["doc_id", "source", "lang", "n_chars", "text"],
                             "doc_id", "source", {"text": tampered.otherwise(F.col("text"))})
