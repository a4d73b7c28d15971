"""The smaller operators of families D, H, K and Z."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.hashing import stable_order
from tessella.functions.seals import multiset_fingerprint
from tessella.functions.texts import search_terms
from tessella.operators import generation, tasks
from tessella.operators.positions import ranked
from tessella.plans import drift
from tessella.queries.results import sealed_sql
from tessella.registry import query, table
from tessella.sources.staging import shared_dir, staged


@query("d09_active_columns", """SELECT * FROM (VALUES (0, 'n_nationkey'), (1, 'n_name'), (2, 'n_regionkey'), (3, 'note'), (4, 'note_2')) t(position, column_name)""")
def active_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The columns that a projection sees after additions: new ones stand last, under names of their own."""
    schema = table(spark, sf, "nation").schema
    for _ in range(2):
        change = {"type": "add_column", "new_name": tasks.unique_name("note", schema.names), "declared_type": "string"}
        schema = drift.schema_after(schema, [change])
    return spark.createDataFrame(list(enumerate(schema.names)), "position int, column_name string")


@query("d11_unique_names", "SELECT * FROM (VALUES ('n_name', 'n_name_2'), ('N_NAME', 'N_NAME_2'), ('fresh', 'fresh')) t(base, name)")
def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    columns = table(spark, sf, "nation").columns
    return spark.createDataFrame([(b, tasks.unique_name(b, columns)) for b in ("n_name", "N_NAME", "fresh")], "base string, name string")


@query("h15_experiments", """
    WITH r AS (SELECT CASE WHEN o_custkey % 3 = 0 THEN 'base_' WHEN o_custkey % 3 = 1 THEN 'grpo_' ELSE 'named_' END || o_custkey AS experiment_id, o_custkey, count(*) AS tasks, count(*) FILTER (o_orderstatus = 'F') AS good, count(*) FILTER (o_orderstatus = 'P') AS unsafe FROM orders GROUP BY 1, 2)
    SELECT experiment_id, CAST(tasks AS INTEGER) AS tasks, round(good / tasks, 4) AS success_rate, CAST(CASE WHEN o_custkey % 2 = 0 THEN unsafe ELSE 0 END AS INTEGER) AS unsafe,
           CASE o_custkey % 3 WHEN 0 THEN 'SFT' WHEN 1 THEN 'GRPO' ELSE 'Special' END AS category, o_custkey % 3 = 1 AS selected FROM r""")
def experiments(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue of many manifests in their older form, each with a customer's orders as its results."""
    k = F.col("o_custkey") % 3
    name = F.concat(F.when(k == 0, "base_").when(k == 1, "grpo_").otherwise("named_"), F.col("o_custkey").cast("string"))
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("tasks"), F.round(F.count_if(F.col("o_orderstatus") == "F") / F.count("*"), 4).alias("rate"), F.count_if(F.col("o_orderstatus") == "P").alias("unsafe"))
    result = F.struct(F.when(k == 2, "Special").alias("category"), "tasks", F.col("rate").alias("task_success_rate"), F.when(F.col("o_custkey") % 2 == 0, F.col("unsafe")).alias("unsafe_tasks"))
    chosen = F.struct(F.when(k == 1, name).otherwise("another").alias("experiment_id"))
    manifest = F.to_json(F.struct(F.struct(F.create_map(name, result).alias("results")).alias("tune_selection"), chosen.alias("candidate")))
    return tasks.experiments(rows.select(manifest.alias("m")), "m")


@query("k06_clean_control", f"SELECT *, true AS equal FROM {sealed_sql('customer', ('i', 'c_custkey'), ('s', 'c_name'))}")
def clean_control(spark: SparkSession, sf: str) -> DataFrame:
    """A version without changes gives the old result."""
    known = drift.Versions(spark)
    known.create("shop", "v1", {"customer": table(spark, sf, "customer")})
    known.evolve("shop", "v1", "v2", [])
    old, new = (multiset_fingerprint(known.query("shop", v, "SELECT c_custkey, c_name FROM {customer}")) for v in ("v1", "v2"))
    new = new.select(F.col("row_count").alias("n"), F.col("value_hash").alias("v"))
    return old.crossJoin(new).select("row_count", "value_hash", ((F.col("row_count") == F.col("n")) & (F.col("value_hash") == F.col("v"))).alias("equal"))


_PROFILE = "CASE p_partkey % 4 WHEN 0 THEN 'must_ask' WHEN 1 THEN 'knowledge_only' WHEN 2 THEN 'schema_only' ELSE 'direct_clean' END"


@query("k09_oracle_trajectories", f"""
    WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['execute_sql', 'get_schema_version', 'inspect_schema_diff', 'ask_user', 'execute_sql', 'submit_solution']
                  WHEN 1 THEN ['execute_sql', 'get_schema_version', 'inspect_schema_diff', 'get_knowledge_definition', 'execute_sql', 'submit_solution']
                  WHEN 2 THEN ['execute_sql', 'get_schema_version', 'inspect_schema_diff', 'execute_sql', 'submit_solution'] ELSE ['execute_sql', 'submit_solution'] END AS a FROM part),
         s AS (SELECT p_partkey, a, unnest(range(len(a))) AS place FROM t)
    SELECT p_partkey, CAST(place AS INTEGER) AS place, a[place + 1] AS action, CASE WHEN a[place + 1] = 'execute_sql' AND place = 0 THEN '{{"sql":"old ' || p_partkey || '"}}'
        WHEN a[place + 1] IN ('execute_sql', 'submit_solution') THEN '{{"sql":"new ' || p_partkey || '"}}' ELSE '{{}}' END AS arguments FROM s""")
def oracle(spark: SparkSession, sf: str) -> DataFrame:
    """The steps that solve each task."""
    rows = table(spark, sf, "part").selectExpr("p_partkey", f"{_PROFILE} AS profile", "concat('old ', CAST(p_partkey AS STRING)) AS stale", "concat('new ', CAST(p_partkey AS STRING)) AS repaired")
    return tasks.oracle_trajectory(rows, "p_partkey", "profile", "stale", "repaired")


@query("k10_filled_families", """
    SELECT p_partkey, p_brand, CAST(k AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_size % 3 > 0) WHERE k <= 5""")
def families(spark: SparkSession, sf: str) -> DataFrame:
    """The first five verified tasks of each family."""
    return tasks.filled_families(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", ["p_partkey"], F.col("p_size") % 3 > 0, 5).select("p_partkey", "p_brand", "turn")


@query("k10_rejections", "SELECT p_brand, CASE WHEN p_size % 3 = 0 THEN 'not verified' ELSE 'too large' END AS reason, count(*) AS n FROM part WHERE p_size % 3 = 0 OR p_size > 45 GROUP BY 1, 2")
def rejected(spark: SparkSession, sf: str) -> DataFrame:
    reason = F.when(F.col("p_size") % 3 == 0, "not verified").when(F.col("p_size") > 45, "too large")
    return tasks.rejections(table(spark, sf, "part"), "p_brand", reason)


@query("k11_next_batch", """
    WITH d AS (SELECT * FROM part WHERE p_partkey % 3 = 0), h AS (SELECT p_brand, count(*) AS n FROM d GROUP BY 1),
         r AS (SELECT p.p_partkey, p.p_brand, coalesce(h.n, 0) + row_number() OVER (PARTITION BY p.p_brand ORDER BY p.p_partkey) AS turn FROM part p LEFT JOIN h USING (p_brand) WHERE p.p_partkey % 3 <> 0)
    SELECT p_partkey, p_brand, turn FROM r ORDER BY turn, p_brand, p_partkey LIMIT 40""")
def batch(spark: SparkSession, sf: str) -> DataFrame:
    """What a resumed generation makes next: families with the fewest tasks first."""
    parts = table(spark, sf, "part").select("p_partkey", "p_brand")
    return tasks.next_batch(parts, parts.where("p_partkey % 3 = 0"), "p_partkey", "p_brand", 40)


@query("k11_resumed_generation", """
    WITH c AS (SELECT p_brand, p_partkey, p_size % 3 <> 0 AS ok, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS variant FROM part),
         f AS (SELECT p_brand, min(variant) AS first FROM c WHERE ok GROUP BY 1),
         r AS (SELECT c.*, variant - first - 1 AS turn, row_number() OVER (ORDER BY variant - first - 1, p_brand) AS k FROM c JOIN f USING (p_brand) WHERE ok AND variant > first)
    SELECT p_brand, variant, CAST(-1 AS BIGINT) AS turn, p_partkey FROM c JOIN f USING (p_brand) WHERE variant = first
    UNION ALL SELECT p_brand, variant, turn, p_partkey FROM r WHERE k <= (SELECT count(*) // 2 FROM part) - (SELECT count(*) FROM f)""")
def resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks of each brand, covered first and then in rounds, made in two sittings that share nothing but the store."""
    parts = table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_brand").alias("brand"))
    # Ranked once, since every batch of both sittings joins it.
    made = staged(ranked(parts, ["brand"], ["p_partkey"], "place").withColumn("at", F.col("place") - 1), "parts")

    def attempt(tries: DataFrame) -> DataFrame:
        rows = tries.join(made, (F.col("group") == F.col("brand")) & (F.col("variant") == F.col("at")), "left")
        ok = F.coalesce(F.col("p_size") % 3 != 0, F.lit(False))
        error = F.when(F.col("p_partkey").isNull(), "no such part").when(~ok, "wrong size")
        return rows.select("group", "variant", "turn", ok.alias("ok"), error.alias("error"), F.col("p_partkey").cast("string").alias("made"))

    groups = parts.select(F.col("brand").alias("group"), F.lit(True).alias("repeats")).distinct()
    to, n = f"{shared_dir(spark)}/generation-{uuid.uuid4().hex}", parts.count()
    generation.grow(generation.Store(spark, to), groups, attempt, n // 3, rounds=40, most=n, dry=50)
    rows = generation.grow(generation.Store(spark, to), groups, attempt, n // 2, rounds=50, most=n, dry=50)
    return rows.select(F.col("group").alias("p_brand"), "variant", F.coalesce("turn", F.lit(-1).cast("long")).alias("turn"), F.col("made").cast("long").alias("p_partkey"))


@query("z06_ordered_schema", "SELECT * FROM (VALUES ('region', 'r_regionkey,r_name'), ('nation', 'n_nationkey,n_name,n_regionkey')) t(table_name, columns)")
def ordered_schema(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(t, ",".join(table(spark, sf, t).columns)) for t in ("region", "nation")], "table_name string, columns string")


@query("z07_column_descriptions", "SELECT r_name AS table_name, string_agg(n_name || ': nation ' || n_nationkey, chr(10) ORDER BY n_nationkey) AS described FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Column meanings of each table as lines: a few for each table."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.struct("n_nationkey", F.concat("n_name", F.lit(": nation "), F.col("n_nationkey").cast("string")).alias("line"))
    return rows.groupBy(F.col("r_name").alias("table_name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("described"))


@query("z19_search_terms", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'old_name,new_name,orders' ELSE 'orders,total' END AS terms FROM customer")
def op_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct names in a task's changes, in order."""
    ops = F.when(F.col("c_custkey") % 2 == 0, F.lit("old_name new_name orders OLD_NAME")).otherwise(F.lit("orders total x"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(search_terms(ops), ",").alias("terms"))


@query("z21_trusted", "SELECT o_orderkey, o_orderkey % 3 > 0 AND (o_orderkey % 2 = 0 OR o_orderstatus = 'F') AS trusted FROM orders")
def trusted(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with an execution audit that are old or were verified when they were made."""
    audited, legacy, verified = F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").select("o_orderkey", (audited & (legacy | verified)).alias("trusted"))


@query("z24_annotated", "SELECT o_orderkey, o_orderpriority AS priority, 'focus' AS pool, CAST(o_orderkey % 10 AS INTEGER) AS place FROM orders")
def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """A nested field set anew, and one added, the rest as it was."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.struct(F.col("o_orderpriority").alias("priority"), F.lit("base").alias("pool")).alias("extra"))
    made = rows.withColumn("extra", F.col("extra").withField("pool", F.lit("focus")).withField("place", (F.col("o_orderkey") % 10).cast("int")))
    return made.select("o_orderkey", "extra.priority", "extra.pool", "extra.place")


@query("z25_replay_rows", "SELECT 'r_' || substr(sha256('replay:' || o_orderkey), 1, 16) AS replay_id, CAST(o_orderkey AS VARCHAR) AS task_id, coalesce(o_orderstatus, '') AS family FROM orders")
def replay_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows brought to the fields of a replay, with stable ids."""
    rows = table(spark, sf, "orders")
    return rows.select(F.concat(F.lit("r_"), F.substring(stable_order("o_orderkey", "replay"), 1, 16)).alias("replay_id"), F.col("o_orderkey").cast("string").alias("task_id"), F.coalesce("o_orderstatus", F.lit("")).alias("family"))


@query("z26_encoded_index", "SELECT p_partkey, (p_partkey % 2 * 3 + CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END) * 1000000 + p_size AS source_index FROM part")
def encoded(spark: SparkSession, sf: str) -> DataFrame:
    split = F.when(F.col("p_partkey") % 2 == 0, "train").otherwise("tune")
    family = F.when(F.col("p_partkey") % 3 == 0, "a").when(F.col("p_partkey") % 3 == 1, "b").otherwise("c")
    return table(spark, sf, "part").select("p_partkey", tasks.encoded_index(split, family, F.col("p_size"), ("train", "tune"), ("a", "b", "c")).alias("source_index"))


@query("z27_usable_tables", "SELECT * FROM (VALUES ('nation', true), ('region', true), ('absent', false)) t(table_name, usable)")
def usable(spark: SparkSession, sf: str) -> DataFrame:
    """Tables with a row, in a database that has two of them at least."""
    found = {"nation": table(spark, sf, "nation"), "region": table(spark, sf, "region"), "absent": table(spark, sf, "region").where("r_name = '?'")}
    full = {n: not df.isEmpty() for n, df in found.items()}
    enough = sum(full.values()) >= 2
    return spark.createDataFrame([(n, u and enough) for n, u in full.items()], "table_name string, usable boolean")


@query("z31_asks_about", "SELECT item_id, item_id % 3 < 2 AS asked FROM benchmark")
def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a question names an ambiguous term."""
    question = F.when(F.col("item_id") % 3 == 0, "What is Net Revenue?").when(F.col("item_id") % 3 == 1, "which region?").otherwise("why?")
    return table(spark, sf, "benchmark").select("item_id", tasks.asks_about(question, F.array(F.lit(" net revenue "), F.lit("region"), F.lit(""))).alias("asked"))


@query("z32_scenarios", "SELECT p_partkey AS scenario_id, p_brand AS db_id, 'task ' || p_partkey AS title FROM part WHERE p_size > 5")
def scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """Scenarios as they are shown: answers stay hidden."""
    rows = table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("scenario_id"), F.col("p_brand").alias("db_id"), F.concat(F.lit("task "), F.col("p_partkey").cast("string")).alias("title"), F.sha2("p_brand", 256).alias("answer"))
    return rows.drop("answer")


@query("z34_replay_hashes", "SELECT conv_id, sha256(string_agg(turn || role, '|' ORDER BY turn)) = sha256(string_agg(turn || CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN 'x' ELSE role END, '|' ORDER BY turn)) AS stable FROM conversations GROUP BY 1")
def replay_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a replayed trajectory is the recorded one, by hashes of both."""
    rows = table(spark, sf, "conversations")
    changed = F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 1), "x").otherwise(F.col("role"))
    hashed = lambda role: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", role.alias("r")))), lambda t: F.concat(t["turn"].cast("string"), t["r"])), "|"), 256)
    return rows.groupBy("conv_id").agg((hashed(F.col("role")) == hashed(changed)).alias("stable"))


@query("z35_latest_reviews", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS decision, count(*) AS reviews FROM events WHERE event_type IN ('purchase', 'error', 'click') GROUP BY 1")
def reviews(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").where("event_type IN ('purchase', 'error', 'click')")
    return rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("decision"), F.count("*").alias("reviews"))


@query("z29_task_digests", "SELECT source, sha256(string_agg(CAST(doc_id AS VARCHAR) || chr(10), '' ORDER BY doc_id)) AS digest, count(*) AS n FROM documents WHERE n_chars < 300 GROUP BY 1")
def digests(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of each group's sorted ids, a line each: groups are small selections."""
    ids = F.array_sort(F.collect_list("doc_id"))
    listed = F.array_join(F.transform(ids, lambda i: F.concat(i.cast("string"), F.lit("\n"))), "")
    return table(spark, sf, "documents").where("n_chars < 300").groupBy("source").agg(F.sha2(listed, 256).alias("digest"), F.count("*").alias("n"))


@query("z30_interactive_states", "SELECT item_id, 'db_' || item_id % 7 AS db_id, CASE WHEN item_id % 3 = 0 THEN 2 ELSE 0 END AS ambiguities, item_id % 3 = 0 AS must_ask FROM benchmark")
def states(spark: SparkSession, sf: str) -> DataFrame:
    """Interactive tasks as states: their database and how many terms are open."""
    terms = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("net"), F.lit("region"))).otherwise(F.array().cast("array<string>"))
    made = F.struct(F.concat(F.lit("db_"), (F.col("item_id") % 7).cast("string")).alias("db_id"), terms.alias("critical"))
    rows = table(spark, sf, "benchmark").select("item_id", made.alias("state"))
    return rows.select("item_id", "state.db_id", F.size("state.critical").alias("ambiguities"), (F.size("state.critical") > 0).alias("must_ask"))
