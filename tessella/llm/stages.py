"""Operators as filtering stages: documents in, documents of the same columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import langid, mixing, ngram_join, pieces, substring
from .common import drop_keys, staged

#: A document whose language is less sure than this is rejected, as is one without letters.
LEAST_SURE = 0.35


def keep_known_language(docs: DataFrame) -> DataFrame:
    """Drops documents without a letter or of no language that the network is sure of."""
    # Under names of their own, so that no column clashes with the answer's.
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rows = langid.identify(docs.withColumnsRenamed(names), langid.fitted(docs), tuple(names.values()))
    kept = rows.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SURE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({v: k for k, v in names.items()}).select(docs.columns)


def keep_one_of_each_group(docs: DataFrame) -> DataFrame:
    """Keeps the smallest doc_id of each component of near copies, and all documents without words."""
    found = ngram_join.jaccard_components(docs)
    gone = staged(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = drop_keys(docs, gone, "doc_id")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    # Rows that repeat a doc_id: the first stays.
    one = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    return kept.withColumn("__row", F.row_number().over(one)).where("__row = 1 or doc_id is null").drop("__row")


def cut_repeated_passages(docs: DataFrame) -> DataFrame:
    """Cuts passages that an earlier document has; every document stays."""
    return substring.drop_repeats(docs)


def mix(docs: DataFrame, targets: mixing.Targets) -> DataFrame:
    """Samples documents to the target mixture."""
    return mixing.sampled(docs, targets)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return pieces.digests(docs, path)
