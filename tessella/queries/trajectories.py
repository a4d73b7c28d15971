"""Family F: conversations stand for chat trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import trajectories
from tessella.registry import query, table


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


@query("t13_identities", """
    SELECT conv_id, sha256(string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn)) AS trajectory FROM conversations GROUP BY 1""")
def identities(spark: SparkSession, sf: str) -> DataFrame:
    return trajectories.identities(turns(spark, sf))


@query("t18_next_actions", """
    SELECT conv_id, turn AS target_turn, (SELECT count(*) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn) AS prefix_turns,
           (SELECT sum(length(coalesce(p.text, ''))) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn) AS prefix_chars FROM conversations c WHERE role = 'assistant'""")
def next_actions(spark: SparkSession, sf: str) -> DataFrame:
    return trajectories.next_actions(turns(spark, sf)).select("conv_id", F.col("turn").alias("target_turn"), "prefix_turns", "prefix_chars")


@query("t19_targets", """SELECT conv_id, turn, sha256(rtrim(text, ' ' || chr(10)) || chr(10) || '{"name":"say","arguments":{"size":' || length(text) || '}}') AS target FROM conversations WHERE role = 'assistant'""")
def targets(spark: SparkSession, sf: str) -> DataFrame:
    """What an assistant said, followed by its call as plain JSON; shown as a digest."""
    call = F.to_json(F.struct(F.lit("say").alias("name"), F.struct(F.length("text").alias("size")).alias("arguments")))
    target = F.concat(F.regexp_replace("text", r"[ \n]+$", ""), F.lit("\n"), call)
    return turns(spark, sf).where("role = 'assistant'").select("conv_id", "turn", F.sha2(target, 256).alias("target"))


@query("t20_repeated", "SELECT conv_id, turn, CAST(unnest(range(CASE WHEN role = 'assistant' THEN 3 WHEN role = 'system' THEN 1 ELSE 2 END)) AS INTEGER) AS copy FROM conversations")
def repeated(spark: SparkSession, sf: str) -> DataFrame:
    times = F.when(F.col("role") == "assistant", 3).when(F.col("role") == "system", 1).otherwise(2)
    return trajectories.repeated(turns(spark, sf), times).select("conv_id", "turn", "copy")


@query("t24_expected_sequence", """
    SELECT doc_id, CASE lang WHEN 'en' THEN 'execute_sql>submit_solution' WHEN 'fr' THEN 'get_schema_version>inspect_schema_diff>ask_user>execute_sql>submit_solution'
        WHEN 'de' THEN 'get_schema_version>inspect_schema_diff>search_knowledge>execute_sql>submit_solution' ELSE 'get_schema_version>inspect_schema_diff>execute_sql>submit_solution' END AS tools FROM documents""")
def expected(spark: SparkSession, sf: str) -> DataFrame:
    profile = F.when(F.col("lang") == "en", "direct_clean").when(F.col("lang") == "fr", "must_ask").when(F.col("lang") == "de", "knowledge_only").otherwise("schema_only")
    return table(spark, sf, "documents").select("doc_id", F.array_join(trajectories.expected_tools(profile), ">").alias("tools"))


@query("t29_terms", r"SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS n_terms FROM benchmark")
def terms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.size(trajectories.terms(F.col("text"), "[a-z0-9_]+")).cast("long").alias("n_terms"))


@query("t30_observation_success", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) > 50, false) AS success FROM events")
def observation(spark: SparkSession, sf: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf, "events").select("event_id", F.coalesce(k > 50, F.lit(False)).alias("success"))


@query("t32_traces", "SELECT conv_id, string_agg(upper(substr(role, 1, 1)), '' ORDER BY turn) AS trace FROM conversations GROUP BY 1")
def traces(spark: SparkSession, sf: str) -> DataFrame:
    return trajectories.traces(turns(spark, sf), F.upper(F.substring("role", 1, 1)))


@query("z23_last_json_line", """SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS size FROM conversations""")
def last_line(spark: SparkSession, sf: str) -> DataFrame:
    """The last line of a message that parses as a JSON object."""
    said = F.concat(F.lit("not json\n"), F.to_json(F.struct(F.length("text").alias("size"))), F.lit("\n{broken"))
    return turns(spark, sf).select("conv_id", "turn", F.get_json_object(trajectories.last_json_line(said), "$.size").cast("long").alias("size"))
