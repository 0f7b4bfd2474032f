"""The corpus pipeline: documents through five stages, each written and read again as the next one's documents.

quality (documents that the rules reject go), near_dedup (of each group the smallest doc_id stays; five-word shingles, 0.8),
decontaminate (documents with a passage of the benchmark go), secrets (spans are masked in the text), encode (ids of the
remaining texts, by hash). All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from beamfold.llm import decontaminate, neardup, pieces, quality, secrets
from beamfold.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.unique(docs, neardup.Rule())


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(docs, pieces.model_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality", _quality), ("near_dedup", _near_dedup), ("decontaminate", _decontaminate), ("secrets", _secrets), ("encode", _encode)]

#: SQL expresses neither the tokenizer nor the order of merges; the tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
