"""The event store as a stream: running totals, and per-session counters that survive restarts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources.staging import shared_dir

EVENTS = T.StructType.fromDDL("event_id long, ts timestamp, user_id long, event_type string, value double, props string")


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files of a folder as they appear."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").option("recursiveFileLookup", "true").parquet(sf_dir)


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, n, total: what a stream has summed when it has read all files there are. Each batch writes the totals so far to the shared folder."""
    totals = stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))
    to = f"{shared_dir(spark)}/totals-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        # A batch that is run again writes the same folder anew.
        batch.write.mode("overwrite").parquet(f"{to}/batch={number}")

    run = totals.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{to}-checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    written = spark.read.parquet(to)
    return written.where(F.col("batch") == written.agg(F.max("batch")).first()[0]).drop("batch")


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window of event time, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def append_batches(events: DataFrame, to: str, checkpoint: str):
    """Appends a stream to a Parquet store, each micro-batch once."""
    return events.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).partitionBy("event_type").trigger(availableNow=True).start()


def windowed_store(spark: SparkSession, sf_dir: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n: the windows that a stream has closed when it has read all files there are, read from its store."""
    to = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    closed = windowed(stream(spark, sf_dir), width, late).select(F.col("window.start").alias("start"), "event_type", "n")
    append_batches(closed, to, f"{to}-checkpoint").awaitTermination()
    return spark.read.schema("start timestamp, n long, event_type string").parquet(to).select("start", "event_type", "n")
