"""Evaluation metrics, and paired comparison over rollout rows.

A rollout row has success, unsafe, termination, tool_calls and n_chars (tokens).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.positions import ranked

#: Terminations that submitted something.
SUBMITTED = ("submitted", "fallback_submitted", "contract_validated_auto_submit")


def evaluation() -> list[Column]:
    """n, success_rate, submit_precision (0 where nothing was submitted), unsafe, mean_tools."""
    submitted = F.col("termination").isin(*SUBMITTED)
    sent = F.count_if(submitted)
    return [
        F.count("*").alias("n"),
        F.round(F.count_if("success") / F.count("*"), 6).alias("success_rate"),
        F.when(sent == 0, 0.0).otherwise(F.round(F.count_if(F.col("success") & submitted) / sent, 6)).alias("submit_precision"),
        F.count_if("unsafe").alias("unsafe"),
        F.round(F.avg("tool_calls"), 6).alias("mean_tools"),
    ]


def wilson(good: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a rate; (0, 0) of no rows."""
    n = F.nullif(n, F.lit(0))
    p, zz = good / n, z * z
    middle, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return tuple(F.coalesce(x / (1 + zz / n), F.lit(0.0)) for x in (middle - half, middle + half))


def paired(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """n, gains, losses, both over shared keys; each side has the key and ``ok``."""
    rows = first.withColumnRenamed("ok", "a").join(second.withColumnRenamed("ok", "b"), key)
    a, b = F.col("a"), F.col("b")
    return rows.agg(F.count("*").alias("n"), F.count_if(b & ~a).alias("gains"), F.count_if(a & ~b).alias("losses"), F.count_if(a & b).alias("both"))


def quantiles(df: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """group and a column for each point (name to share, 0 to 1): exact quantiles, between two values in proportion; null values don't count.

    Values are ranked by ranges of (group, value), so a group may be as large as the table: a range and one row for each
    range and group in it is all that a task holds. Only the two rows about each point are gathered.
    """
    ranks = ranked(df.select(group, F.col(value).cast("double").alias("__v")).where("__v is not null"), [group], ["__v"], "__r", "__n")
    at = {name: share * (F.col("__n") - 1) + 1 for name, share in points.items()}
    near = None
    for place in at.values():
        here = F.col("__r").isin(F.floor(place), F.ceil(place))
        near = here if near is None else near | here
    out = []
    for name, place in at.items():
        low, high = (F.max(F.when(F.col("__r") == f(place), F.col("__v"))) for f in (F.floor, F.ceil))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return ranks.where(near).groupBy(group).agg(*out)
