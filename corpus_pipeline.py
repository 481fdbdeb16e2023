"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of
`docs`. Null texts are texts without a letter and go in the first stage; extra columns pass
through the first four; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from faturalens.llm import bpe_encode, common, jaccard_join, language, mixing, toxicity


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: texts without a letter go, and those whose language scores below `language.LEAST_SCORE`."""
    common.prepare(spark)
    return language.accepted(docs, language.learn(docs))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    common.prepare(spark)
    return toxicity.clean(docs, toxicity.learn(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    common.prepare(spark)
    return jaccard_join.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken, up to twice."""
    common.prepare(spark)
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_decoded and ids: what training reads, and the length of what it decodes to."""
    common.prepare(spark)
    return bpe_encode.round_trip(docs)


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

# Learned models and an iterative join decide which rows stay: SQL can't express that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over `documents`; what each returns is written to a folder, by default one in the shared checkpoint folder."""
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = folder or f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
