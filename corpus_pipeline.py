"""A corpus made ready for training, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; between stages the rows are written as Parquet and read again.

Edge cases, in every stage: null texts count as empty ones and null doc_ids are
rows like others, but for what a stage says of them; very long texts are worked on
whole; repeated rows are judged alike; an empty table gives no rows of the same
columns; columns beside doc_id and text pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontamination, near_duplicates, personal_data, quality, sentencepieces
from tessera.llm.storage import persist

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go: those without 50 words, null and empty
    texts among them.  The order of the rules, by chance or tie, changes no verdict."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that with the least doc_id; of rows that
    repeat this doc_id, one.  Rows with a null doc_id stay."""
    return near_duplicates.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, and rows that share their doc_id,
    null included.  An empty benchmark leaves all."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and n_chars counted again, where it
    is there.  Overlapping spans are one stretch of the first kind; null texts stay null."""
    out = personal_data.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(out.schema["n_chars"].dataType), "n_chars")) if "n_chars" in out.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts, by their digests; a null text gives begin and end."""
    return sentencepieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact", redact),
    ("encode", encode),
]

#: Sampling, transducers and a tokenizer have no SQL; tests/llm holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = persist(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
