"""A training corpus from ``documents``: five stages, each a Spark job over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import stages
from tessella.llm.common import shared_dir, table
from tessella.llm.queries import MIXTURE, tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: rejected documents go."""
    return stages.keep_known_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays."""
    return stages.keep_one_of_each_group(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages repeated across documents are cut."""
    return stages.cut_repeated_passages(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: a calibrated sample."""
    return stages.mix(docs, MIXTURE)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding: digests of ids and decoded text."""
    return stages.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("passages", passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: No SQL: learned models and MinHash stand in the stages; tests compare stages with brute force where there is one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder and read again.

    Null texts and texts without a letter go in the first stage; rows without doc_id pass all stages and are drawn like others;
    of rows that repeat a doc_id the second stage keeps the first by text; null languages and sources are levels of
    their own; extra columns are carried up to the last stage; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
