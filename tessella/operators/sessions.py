"""Sessions of ordered events: sequences, latest state, policies over what has happened, operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequenced(df: DataFrame, session: str, order: Sequence[str]) -> DataFrame:
    """``sequence``: 1, 2, ... without gaps in each session."""
    return df.withColumn("sequence", F.row_number().over(Window.partitionBy(session).orderBy(*order)).cast("long"))


def after(df: DataFrame, sequence: int) -> DataFrame:
    """Events that a reader who has seen ``sequence`` hasn't."""
    return df.where(F.col("sequence") > sequence)


def latest(df: DataFrame, key: str, order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Each key's last row: key, order and carried columns, by a maximum with map-side combining."""
    return df.groupBy(key).agg(F.max(F.struct(*order, *carry)).alias("__x")).select(key, "__x.*")


def interrupted(df: DataFrame, status: str, running: Sequence[str], to: str) -> DataFrame:
    """Sessions that still run become ``to``."""
    return df.withColumn(status, F.when(F.col(status).isin(*running), to).otherwise(F.col(status)))


def first_rule(rules: Sequence[tuple[str, str]], other: str) -> Column:
    """The name of the first rule whose condition holds."""
    out = None
    for name, condition in rules:
        out = F.when(F.expr(condition), name) if out is None else out.when(F.expr(condition), name)
    return F.lit(other) if out is None else out.otherwise(other)


def operations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """n, errors, error_rate (0 for none) and users of each group."""
    errors = F.count_if(F.col("event_type") == "error")
    rate = F.when(F.count("*") == 0, 0.0).otherwise(errors / F.count("*"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), errors.alias("errors"), F.round(rate, 4).alias("error_rate"), F.count_distinct("user_id").alias("users"))


def trace(df: DataFrame, session: str, sequence: str, action: str) -> DataFrame:
    """A session's actions in order, as text."""
    pairs = F.array_sort(F.collect_list(F.struct(sequence, action)))
    return df.groupBy(session).agg(F.array_join(F.transform(pairs, lambda p: p[action]), ">").alias("trace"))
