"""An event store that grows: gap-free numbers in each session, continued from what is stored.

Folders ``events/batch=N`` hold the numbered rows, ``heads/batch=N`` the newest number of each session that batch N touched, or
of all sessions in every SNAPSHOT-th batch, so few folders tell where a session stands. A batch looks at smaller batches only and
overwrites its own folders: run twice, or again after it broke off between its two writes, it leaves the same store.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.positions import ranked

#: Every so many batches the heads of all sessions are written together.
SNAPSHOT = 16


def _heads(spark: SparkSession, to: str, before: int, key: str, kind: str) -> DataFrame | None:
    """key, sequence: the newest number of each session ahead of batch ``before``."""
    first = max(0, (before - 1) // SNAPSHOT * SNAPSHOT)
    if before <= 0:
        return None
    rows = spark.read.schema(f"{key} {kind}, sequence long, batch int").parquet(f"{to}/heads").where((F.col("batch") >= first) & (F.col("batch") < before))
    return rows.groupBy(key).agg(F.max("sequence").alias("sequence"))


def append(to: str, batch: DataFrame, number: int, key: str, order: Sequence[str]) -> None:
    """Adds rows as batch ``number`` (0, 1, ...) to the store ``to``, with ``sequence`` going on in each session in the order of ``order``."""
    spark, kind = batch.sparkSession, batch.schema[key].dataType.simpleString()
    rows = ranked(batch, [key], list(order), "__rank", "__size")
    heads = _heads(spark, to, number, key, kind)
    if heads is None:
        rows = rows.withColumn("__last", F.lit(0).cast("long"))
    else:
        # One head for each session.
        old = heads.select(F.col(key).alias("__key"), F.col("sequence").alias("__last"))
        rows = rows.join(old, F.col(key).eqNullSafe(F.col("__key")), "left").withColumn("__last", F.coalesce("__last", F.lit(0).cast("long"))).drop("__key")
    written = rows.withColumn("sequence", F.col("__last") + F.col("__rank")).drop("__last", "__rank", "__size")
    written.write.mode("overwrite").parquet(f"{to}/events/batch={number}")
    new = spark.read.schema(written.schema).parquet(f"{to}/events/batch={number}").groupBy(key).agg(F.max("sequence").alias("sequence"))
    if heads is not None and number % SNAPSHOT == 0:
        new = heads.unionByName(new).groupBy(key).agg(F.max("sequence").alias("sequence"))
    new.write.mode("overwrite").parquet(f"{to}/heads/batch={number}")


def append_stream(events: DataFrame, to: str, checkpoint: str, key: str, order: Sequence[str]) -> None:
    """Numbers what a stream has; a micro-batch that is run again after a failure writes the same rows."""
    run = events.writeStream.foreachBatch(lambda rows, number: append(to, rows, number, key, order)).option("checkpointLocation", checkpoint)
    run.trigger(availableNow=True).start().awaitTermination()


def stored(spark: SparkSession, to: str, schema: str) -> DataFrame:
    """All rows of the store. schema: of its columns, ``sequence`` among them."""
    return spark.read.schema(f"{schema}, batch int").parquet(f"{to}/events").drop("batch")
