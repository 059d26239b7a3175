"""From documents to encoded training data, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs.

Defined results. Null texts have no words and are rejected by the first stage, as are
empty ones; an empty table runs through all stages; very long texts are worked on as a
whole. Rows that share an id are judged each on its own by ``quality`` and
``personal_data``; ``near_duplicates`` keeps one of them, ``mixing`` and ``encoding`` one
decision and a row each. Rows without id stay. Any column may be null, and further
columns, whatever their names, are carried to the last stage but one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import bpe_rounds, cube_mix, near_copies, pii_crf, quality_ledger
from folioframe.llm.common import remove, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the current policy rejects."""
    return quality_ledger.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return near_copies.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts."""
    return pii_crf.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents to the sources' target weights; one taken twice has two rows."""
    return cube_mix.apply_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    coded = bpe_rounds.encode(docs, bpe_rounds.default_path())
    return coded.select("doc_id", "n_tokens", "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("encoding", encoding)]

#: The stages go beyond SQL (fingerprints, a trained field, a sampler, merges).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each by way of Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:  # what a stage has read is not read again
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
