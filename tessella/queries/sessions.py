"""Family H: an append-only event store; users stand for sessions, event types for tool events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import sessions
from tessella.registry import query, table
from tessella.sources.staging import shared_dir
from tessella.streaming import sessions as live
from tessella.streaming import store


def events(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.sequenced(table(spark, sf, "events"), "user_id", ["ts", "event_id"])


_EVENTS = "SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS sequence FROM events"


@query("h01_sequenced", f"SELECT user_id, event_id, sequence FROM ({_EVENTS})")
def sequenced(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("user_id", "event_id", "sequence")


_ARRIVED = "SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, ts, event_id) AS BIGINT) AS sequence FROM events"


@query("h01_appended", f"SELECT user_id, event_id, sequence FROM ({_ARRIVED})")
def appended(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in a store that grows by three batches, the second of which comes twice."""
    to = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts")
    for number in (0, 1, 1, 2):
        store.append(to, rows.where(F.col("event_id") % 3 == number), number, "user_id", ["ts", "event_id"])
    return store.stored(spark, to, "user_id long, event_id long, sequence long")


@query("h02_resume", f"SELECT user_id, sequence, event_type FROM ({_EVENTS}) WHERE sequence > 5")
def resume(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.after(events(spark, sf), 5).select("user_id", "sequence", "event_type")


@query("h03_recent_page", "SELECT user_id, min(ts) AS created_at FROM events GROUP BY 1 ORDER BY created_at DESC, user_id LIMIT 20 OFFSET 20")
def page(spark: SparkSession, sf: str) -> DataFrame:
    created = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"))
    return created.orderBy(F.desc("created_at"), "user_id").offset(20).limit(20)


@query("h04_payloads", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'purchase'")
def payloads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("h05_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at FROM events GROUP BY 1")
def state(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.latest(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", F.col("event_type").alias("status"), F.col("ts").alias("updated_at"))


@query("h06_interrupted", """
    SELECT user_id, CASE WHEN status IN ('view', 'click') THEN 'failed' ELSE status END AS status FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1)""")
def interrupted(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.interrupted(state(spark, sf).select("user_id", "status"), "status", ["view", "click"], "failed")


_RULES = "CASE WHEN event_type = 'error' AND value > 100 THEN 'timeout' WHEN event_type = 'error' THEN 'tool_error' WHEN value IS NULL THEN 'missing' WHEN value < 0 THEN 'unsafe' ELSE 'none' END"
RULES = (("timeout", "event_type = 'error' AND value > 100"), ("tool_error", "event_type = 'error'"), ("missing", "value IS NULL"), ("unsafe", "value < 0"))


@query("h07_failure_types", f"SELECT event_id, {_RULES} AS failure FROM events")
def failures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", sessions.first_rule(RULES, "none").alias("failure"))


@query("h08_operations_by_day", """
    SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 4) AS error_rate, count(DISTINCT user_id) AS users
    FROM events GROUP BY 1 ORDER BY day DESC LIMIT 30""")
def by_day(spark: SparkSession, sf: str) -> DataFrame:
    """The last 30 days that have events."""
    return sessions.operations(table(spark, sf, "events").withColumn("day", F.to_date("ts")), ["day"]).orderBy(F.desc("day")).limit(30)


@query("h08_operations_by_type", """
    SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 4) AS error_rate, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def by_type(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.operations(table(spark, sf, "events"), ["event_type"])


@query("h09_failure_list", f"SELECT event_id, user_id, failure FROM (SELECT *, {_RULES} AS failure FROM events) WHERE failure <> 'none' ORDER BY event_id LIMIT 50")
def failure_list(spark: SparkSession, sf: str) -> DataFrame:
    """A page of failures."""
    rows = table(spark, sf, "events").withColumn("failure", sessions.first_rule(RULES, "none")).where("failure <> 'none'")
    return rows.orderBy("event_id").limit(50).select("event_id", "user_id", "failure")


@query("h10_stream_matches_batch", "SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1")
def stream(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by a stream over the event files, as far as they are there."""
    from tessella.streaming.events import running_totals

    return running_totals(spark, sf)


@query("h10_windowed_stream", """
    SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY 1, 2""")
def windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events by hour as a stream with a watermark appends them."""
    from tessella.streaming.events import windowed_store

    return windowed_store(spark, sf)


# What readers get: events up to the first error, a sign of life for every 12 hours of silence, as far as the watermark has come.
@query("h10_followed", f"""
    WITH e AS (SELECT *, min(sequence) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS stop, lead(ts) OVER (PARTITION BY user_id ORDER BY sequence) AS next FROM ({_EVENTS})),
         o AS (SELECT *, CASE WHEN sequence = stop THEN ts WHEN next IS NULL THEN date_trunc('millisecond', (SELECT max(ts) FROM events)) - INTERVAL 10 MINUTE ELSE next END AS until FROM e WHERE stop IS NULL OR sequence <= stop)
    SELECT user_id, 'event' AS kind, sequence, ts AS "at", event_type FROM o UNION ALL SELECT user_id, 'end', sequence, ts, NULL FROM o WHERE sequence = stop
    UNION ALL SELECT user_id, 'keepalive', sequence, beat, NULL FROM (SELECT *, unnest(generate_series(ts + INTERVAL 12 HOUR, until, INTERVAL 12 HOUR)) AS beat FROM o) WHERE beat < until""")
def followed(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions as their readers see them, by a stream in three runs that goes on where the last one stopped."""
    rows = live.events_with_times(spark, sf).select("event_id", "user_id", "event_type", "ts", "at")
    fold = live.Follow(12 * 3600 * 10**6, ["error"])
    found = live.in_cuts(rows, "at", 3, lambda stream: live.folded(stream, "user_id", fold, ["at", "event_id"]))
    return found.select("user_id", "kind", "sequence", F.timestamp_micros("at").cast("timestamp_ntz").alias("at"), "event_type")


@query("h12_candidates", f"""
    SELECT user_id, 'p4r_' || substr(sha256(string_agg(event_type || ':' || props, '>' ORDER BY sequence)), 1, 16) AS candidate FROM ({_EVENTS}) GROUP BY 1""")
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("event", F.concat("event_type", F.lit(":"), "props"))
    return sessions.trace(rows, "user_id", "sequence", "event").select("user_id", F.concat(F.lit("p4r_"), F.substring(F.sha2("trace", 256), 1, 16)).alias("candidate"))


@query("h13_review_integrity", """
    WITH r AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS decision, arg_max(sha256(props), (ts, event_id)) AS seen FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1),
         n AS (SELECT user_id, arg_max(sha256(props), (ts, event_id)) AS now FROM events GROUP BY 1)
    SELECT user_id, decision, seen = now AS intact FROM r JOIN n USING (user_id)""")
def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """The last decision on each session, and whether what was reviewed is still its newest state, by hash."""
    rows = table(spark, sf, "events").withColumn("hash", F.sha2("props", 256))
    last = sessions.latest(rows.where("event_type IN ('purchase', 'error')"), "user_id", ["ts", "event_id"], ["event_type", "hash"])
    now = sessions.latest(rows, "user_id", ["ts", "event_id"], ["hash"]).select("user_id", F.col("hash").alias("now"))
    return last.join(now, "user_id").select("user_id", F.col("event_type").alias("decision"), (F.col("hash") == F.col("now")).alias("intact"))


@query("h14_catalogue", "SELECT n_regionkey AS db_id, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS names, count(*) AS n FROM nation GROUP BY 1")
def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of each region: a table of fixed size, so its lists are short."""
    return table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("db_id")).agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"), F.count("*").alias("n"))


@query("t06_repeated_calls", f"""
    SELECT user_id, sequence FROM ({_EVENTS}) e QUALIFY row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY sequence) > 1 AND event_type <> 'error'""")
def repeated(spark: SparkSession, sf: str) -> DataFrame:
    again = Window.partitionBy("user_id", "event_type", "props").orderBy("sequence")
    return events(spark, sf).withColumn("k", F.row_number().over(again)).where("k > 1 AND event_type <> 'error'").select("user_id", "sequence")


@query("t05_newest_validated", f"""
    SELECT user_id, arg_max(value > 50, sequence) AS validated FROM ({_EVENTS}) WHERE event_type = 'purchase' GROUP BY 1""")
def newest(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by(F.col("value") > 50, "sequence").alias("validated"))


@query("x13_last_success", f"SELECT user_id, arg_max(event_id, sequence) AS event_id FROM ({_EVENTS}) WHERE event_type = 'purchase' AND value > 50 GROUP BY 1")
def last_success(spark: SparkSession, sf: str) -> DataFrame:
    from tessella.operators.results import last_success as last

    return last(events(spark, sf), "user_id", ["sequence"], "event_type = 'purchase' AND value > 50", "event_id")
