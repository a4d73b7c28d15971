"""Results as an agent sees them: bounded, with a mark where there is more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of an ordered result and ``truncated``: one row more is read to tell."""
    rows = df.limit(most + 1)
    more = rows.agg((F.count("*") > most).alias("truncated"))
    return rows.limit(most).crossJoin(F.broadcast(more))


def last_success(events: DataFrame, key: str, order: list[str], success: str, value: str) -> DataFrame:
    """The value of each key's last successful event: a maximum with map-side combining."""
    return events.where(success).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))
