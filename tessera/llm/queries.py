"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import decontamination, language_id, near_duplicates, oracle, personal_data, quality, repeated_phrases, sentencepieces, token_counts, toxicity, wavelet
from .storage import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; of a null doc_id that of ''."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(5) == 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    model = toxicity.learn(docs.where("not held_out"), labels)
    return toxicity.score(docs, model, keep=("held_out",))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh cache for each call, so that every call does the whole job."""
    cache = f"{shared_folder(spark)}/tessera/token-cache-{uuid.uuid4().hex}"
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder(4) == 2).alias("held_out"))
    filters = language_id.learn(docs.where("not held_out"))
    return language_id.identify(docs.select("doc_id", "text", "held_out"), filters, keep=("held_out",))


def op4_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_phrases.remove(table(spark, sf_dir, "documents"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.scan(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_repeated_phrases": op4_repeated_phrases,
    "op5_token_binary": op5_token_binary,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_personal_data": op7_personal_data,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op4_repeated_phrases": oracle.REPEATED_PHRASES,
    "op8_quality_rules": oracle.QUALITY_RULES,
    "op9_decontamination": oracle.DECONTAMINATION,
}
