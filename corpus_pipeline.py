"""From raw documents to token ids: five stages, each written as Parquet and read again for the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brinelog.llm import decontamination, language, line_dedup, pieces, simhash_dedup
from brinelog.llm.common import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go."""
    return language.keep_identified(docs, language.fit(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines with 50 words or more that stood earlier are deleted; no document goes."""
    return line_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: texts whose SimHash differs by 4 bits or fewer, or with similar five-word shingles (0.8)."""
    return simhash_dedup.drop_near_duplicates(docs, radius=4)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, items without an id included."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), nameless=True)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, their checksum and the round trip of every document that is left."""
    return pieces.report(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("line_dedup", repeated_lines), ("simhash_dedup", near_duplicates),
    ("decontamination", benchmark_passages), ("sentencepiece", token_ids)]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
