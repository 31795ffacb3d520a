"""Thin queries over the driver's tables, one for each operator, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, langid, license, lm, rules, simhash, tokencount, toxicity
from .common import documents, held_out

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.over_limit(tokencount.count_tokens(documents(spark, sf_dir), tokenizer_path()))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).withColumn("held_out", held_out(F.col("doc_id"), 3, 1))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), tokenizer_path())


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs)).withColumn("held_out", held_out(F.col("doc_id"), 4, 2))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.digests(chat.format_paths(chat.linear(rows)))


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, counts = lm.train(docs)
    return lm.score(docs, model, counts).withColumn("held_out", held_out(F.col("doc_id"), 7, 2))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.apply(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_toxicity": op2_toxicity,
        "op3_bpe": op3_bpe,
        "op4_language": op4_language,
        "op5_simhash": op5_simhash,
        "op6_chat": op6_chat,
        "op7_license": op7_license,
        "op8_decontamination": op8_decontamination,
        "op9_lm_scores": op9_lm_scores,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_chat": chat.ORACLE_SQL, "op8_decontamination": decontam.ORACLE_SQL}
