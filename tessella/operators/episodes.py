"""Episodes: where each tool was first used, how an episode ended, contexts to recover from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("view", "click", "signup", "purchase", "error")


def first_places(df: DataFrame) -> DataFrame:
    """user_id and a column for each kind of event: where it first came (null: never)."""
    return df.groupBy("user_id").agg(*(F.min(F.when(F.col("event_type") == k, F.col("sequence"))).alias(k) for k in KINDS))


def inspection_summary(places: DataFrame) -> DataFrame:
    """How many episodes looked at version and diff in order, did so before executing, or took a shortcut."""
    ordered = F.col("view") < F.col("click")
    shortcut = F.col("purchase").isNotNull() & (F.col("click").isNull() | (F.col("purchase") < F.col("click")))
    return places.agg(F.count("*").alias("n"), F.count_if(ordered).alias("ordered_inspection"), F.count_if(ordered & (F.col("click") < F.col("purchase"))).alias("before_execution"), F.count_if(shortcut).alias("shortcut"))


def terminations(df: DataFrame, most_calls: int, most_runs: int) -> DataFrame:
    """user_id, reason: what came first in each session, by running counts in one window."""
    so_far = Window.partitionBy("user_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = F.count(F.when(F.col("event_type") == "purchase", 1)).over(so_far)
    reason = F.when(F.col("event_type") == "error", "submitted").when(runs > most_runs, "sql_budget").when(F.count("*").over(so_far) > most_calls, "turn_limit")
    rows = df.withColumn("reason", reason)
    first = F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("sequence")))
    ended = F.bool_or(F.col("reason").isNotNull())
    return rows.groupBy("user_id").agg(F.when(ended, first).otherwise("running").alias("reason"))


def recovery_contexts(df: DataFrame) -> DataFrame:
    """Three contexts for each session that failed, with the place of its first failure."""
    failed = df.where("event_type = 'error'").groupBy("user_id").agg(F.min("sequence").alias("first_error"))
    return failed.select("user_id", F.explode(F.array(*(F.lit(c) for c in ("pre_error", "post_error", "terminal")))).alias("context"), "first_error")
