"""Tool calls, SQL and prompts in texts: messages are made around the turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import matching, texts
from tessella.registry import query, table

# A message for each turn: a tagged, fenced, bare and tag-like call, one with arguments as text, and none.
_MESSAGE = r"""CASE turn % 6
    WHEN 0 THEN concat('thinking <tool_call>{"name": "execute_sql", "arguments": {"sql": "SELECT ', CAST(length(text) AS STRING), '"}}</tool_call> done')
    WHEN 1 THEN concat('So:\n```json\n{"name": "submit_solution",\n "arguments": {"sql": " SELECT ', CAST(conv_id AS STRING), ' "}}\n```')
    WHEN 2 THEN concat('x {"name": "get_schema", "arguments": {"n": ', CAST(conv_id AS STRING), '}} y {"success": true} <solution>select 1</solution>')
    WHEN 3 THEN concat('é <function name="ask_user" arguments=\'{"question": "What\'s ', CAST(conv_id AS STRING), '?"}\' /> WITH x AS (SELECT 2) SELECT 3')
    WHEN 4 THEN concat('{"function": {"name": "execute_sql", "arguments": "{\\"sql_list\\": [\\"SELECT ', CAST(conv_id AS STRING), '\\"]}"}}')
    ELSE '{broken {"name": 5} {"name": "x", "arguments": [1]} ```sql\nSELECT 9\n```' END"""
_DUCK = _MESSAGE.replace("AS STRING", "AS VARCHAR").replace(r"\'{", "''{").replace(r"What\'s", "What''s").replace(r"}\' />", "}'' />").replace("\\n", "' || chr(10) || '").replace('\\\\"', '\\"')
_M = f"WITH m AS (SELECT conv_id, turn, text, {_DUCK} AS message FROM conversations)"


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{_MESSAGE} AS message").withColumn("calls", texts.tool_calls("message"))


@query("t01_tool_calls", f"""{_M}
    SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'execute_sql' WHEN 1 THEN 'submit_solution' WHEN 2 THEN 'get_schema' WHEN 3 THEN 'ask_user' ELSE 'execute_sql' END AS name,
        CASE turn % 6 WHEN 0 THEN '{{"sql":"SELECT ' || length(text) || '"}}' WHEN 1 THEN '{{"sql":" SELECT ' || conv_id || ' "}}' WHEN 2 THEN '{{"n":' || conv_id || '}}'
            WHEN 3 THEN '{{"question":"What''s ' || conv_id || '?"}}' ELSE '{{"sql_list":["SELECT ' || conv_id || '"]}}' END AS arguments,
        CAST(CASE turn % 6 WHEN 0 THEN 20 WHEN 1 THEN 12 WHEN 4 THEN 0 ELSE 2 END AS INTEGER) AS "start",
        CAST(CASE turn % 6 WHEN 0 THEN length(message) - 17 WHEN 1 THEN length(message) - 4 WHEN 2 THEN 46 + length(CAST(conv_id AS VARCHAR)) WHEN 3 THEN length(message) - 30 ELSE length(message) END AS INTEGER) AS "end"
    FROM m WHERE turn % 6 < 5""")
def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Tool calls in every wrapper, with their places; what isn't a call is left."""
    return messages(spark, sf).select("conv_id", "turn", F.explode("calls").alias("c")).select("conv_id", "turn", "c.name", "c.arguments", "c.start", "c.end")


@query("t02_without_calls", f"""{_M}
    SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'thinking  done' WHEN 1 THEN 'So:' WHEN 2 THEN 'x  y {{"success": true}} <solution>select 1</solution>'
        WHEN 3 THEN 'é  WITH x AS (SELECT 2) SELECT 3' WHEN 4 THEN '' ELSE message END AS said FROM m""")
def without(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("conv_id", "turn", texts.without_calls("message", "calls").alias("said"))


@query("r23_sql_extraction", """
    SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'SELECT ' || length(text) WHEN 1 THEN 'SELECT ' || conv_id WHEN 2 THEN 'select 1' WHEN 3 THEN 'WITH x AS (SELECT 2) SELECT 3'
        WHEN 4 THEN 'SELECT ' || conv_id ELSE 'SELECT 9' END AS sql FROM conversations""")
def extraction(spark: SparkSession, sf: str) -> DataFrame:
    """SQL by tool call, solution tag, fence or keyword, in this order."""
    return messages(spark, sf).select("conv_id", "turn", texts.candidate_sql("message", "calls").alias("sql"))


@query("r24_reasoning_sql", """
    SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'SELECT ' || conv_id WHEN 1 THEN 'SELECT 2' WHEN 2 THEN 'select 3' ELSE '' END AS sql, turn % 4 < 2 AS plan_tag, turn % 4 = 0 AS sql_tag, turn % 4 = 0 AS exact_wrapper FROM conversations""")
def reasoning(spark: SparkSession, sf: str) -> DataFrame:
    """SQL and form of reasoned answers."""
    said = """CASE turn % 4 WHEN 0 THEN concat('<plan>a</plan> <sql>no</sql> <SQL>\\n`SELECT ', CAST(conv_id AS STRING), '`\\n</SQL>') WHEN 1 THEN '<plan>b\\nc</plan><sql> SELECT 2 <answer>x'
        WHEN 2 THEN 'I say select 3' ELSE 'nothing' END AS said"""
    rows = table(spark, sf, "conversations").selectExpr("conv_id", "turn", said).withColumn("calls", texts.tool_calls("said"))
    return rows.select("conv_id", "turn", texts.reasoning_sql("said", "calls").alias("sql"), *(c.alias(n) for n, c in texts.reasoning_format("said").items()))


@query("r25_fallback_action", """
    SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'submit_solution' WHEN 1 THEN 'execute_sql' WHEN 2 THEN 'execute_sql' END AS tool,
           CASE turn % 4 WHEN 0 THEN 'SELECT ' || conv_id WHEN 1 THEN 'SELECT 1' WHEN 2 THEN 'SELECT 2' END AS sql, turn % 4 = 0 AS submits FROM conversations""")
def fallback(spark: SparkSession, sf: str) -> DataFrame:
    said = """CASE turn % 4 WHEN 0 THEN concat('ok <Submit_Solution> SELECT ', CAST(conv_id AS STRING), ' </submit_solution>') WHEN 1 THEN 'Action: Execute_SQL\\n```sql\\nSELECT 1\\n```'
        WHEN 2 THEN '```\\nSELECT 2```' ELSE 'Action: execute_sql' END AS said"""
    rows = table(spark, sf, "conversations").selectExpr("conv_id", "turn", said)
    return rows.select("conv_id", "turn", texts.fallback_action("said", "execute_sql").alias("a")).select("conv_id", "turn", "a.tool", "a.sql", "a.submits")


_OPS = """CASE p_partkey % 5 WHEN 0 THEN 'add_column' WHEN 1 THEN 'rename_table' WHEN 2 THEN 'rename_column' WHEN 3 THEN 'metric_definition_change' ELSE 'unknown' END AS type, CASE WHEN p_partkey % 3 > 0 THEN 't' END AS `table`,
    'old' AS old_name, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS new_name, 'revenue' AS metric_name, 'a' AS old_expression, 'b' AS new_expression, CAST(NULL AS STRING) AS reason, p_partkey % 2 = 0 AS confirm"""


@query("r27_recovery_guidance", """
    WITH o AS (SELECT p_partkey, p_partkey % 5 AS k, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS b, CASE WHEN p_partkey % 3 > 0 THEN 't' ELSE 'the affected table' END AS t FROM part)
    SELECT p_partkey, CASE WHEN k = 3 THEN 'Metric ''revenue'' changed from ''a'' to ''b'' because the definition changed. Use the new one' || CASE WHEN p_partkey % 2 = 0 THEN ' once the user has confirmed the version.' ELSE '.' END
        WHEN b = '' THEN NULL WHEN k = 0 THEN format('Column ''{}'' is new in {}. Keep the old result columns: expand wildcards to the columns before the change and leave ''{}'' out unless it is asked for.', b, t, b)
        WHEN k = 1 THEN format('Replace table ''old'' by ''{}'' and keep the rest of the query.', b) WHEN k = 2 THEN format('Replace column ''old'' by ''{}'' on {} and keep aliases, predicates, grouping and output.', b, t) END AS guidance FROM o""")
def guidance(spark: SparkSession, sf: str) -> DataFrame:
    """Advice for each change of a schema or metric."""
    from tessella.queries.rollouts import _split

    rows = table(spark, sf, "part").selectExpr("p_partkey", *_split(_OPS))
    return rows.select("p_partkey", texts.recovery_guidance(F.struct(*[c for c in rows.columns if c != "p_partkey"])).alias("guidance"))


@query("r28_clarification_terms", """
    SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'active users' WHEN 1 THEN array_to_string(regexp_extract_all(text, '[A-Za-z0-9_''-]+')[1:6], ' ') WHEN 2 THEN 'old_col' ELSE 'result column contract' END AS term FROM benchmark""")
def clarifications(spark: SparkSession, sf: str) -> DataFrame:
    """The term of a question for each task, from its evidence or its change."""
    k = F.col("item_id") % 4
    evidence = F.when(k == 0, "x = 1; `active users` refers to seen > 3").when(k == 1, "some rule").otherwise("")
    kind = F.when(k == 2, "rename_column").otherwise("add_column")
    return table(spark, sf, "benchmark").select("item_id", texts.clarification_term(evidence, F.col("text"), kind, F.lit("old_col")).alias("term"))


@query("r29_resolved_references", f"""
    WITH g AS (SELECT n_nationkey, '@geo/' || lower(replace(r_name, ' ', '_')) AS r, '@geo/' || lower(replace(r_name, ' ', '_')) || '/' || lower(replace(n_name, ' ', '_')) AS p, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey)
    SELECT c_custkey, 'Of the selected database take column "' || n_name || '" in table "' || r_name || '", table "' || r_name || '" (@geo) and the selected database/none ' || c_custkey || '.' AS question FROM customer JOIN g ON n_nationkey = c_nationkey""")
def references(spark: SparkSession, sf: str) -> DataFrame:
    """Paths in a question said as words, the longest at each place; a replacement that holds a path stays as it is."""
    geo = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    low = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("_")))
    geo = geo.withColumns({"region": F.concat(F.lit("@geo/"), low("r_name")), "path": F.concat(F.lit("@geo/"), low("r_name"), F.lit("/"), low("n_name"))})
    paths = geo.select("path", F.concat(F.lit('column "'), "n_name", F.lit('" in table "'), "r_name", F.lit('"')).alias("said"))
    paths = paths.unionByName(geo.select(F.col("region").alias("path"), F.concat(F.lit('table "'), "r_name", F.lit('" (@geo)')).alias("said")).distinct())
    paths = paths.unionByName(spark.range(1).select(F.lit("@geo").alias("path"), F.lit("the selected database").alias("said")))
    asked = F.concat(F.lit("Of @geo take "), "path", F.lit(", "), "region", F.lit(" and @geo/none "), F.col("c_custkey").cast("string"), F.lit("."))
    rows = table(spark, sf, "customer").join(F.broadcast(geo.select("n_nationkey", "path", "region")), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", asked.alias("question"))
    return matching.replaced(rows, "c_custkey", "question", paths, "path", "said")


@query("r30_masked_tokens", """
    SELECT o_orderkey, 'zeige <KEEP_0> von <KEEP_1>, dann <KEEP_2>' || chr(10) || '<KEEP_3>' || chr(10) || 'und <KEEP_4> ab <KEEP_5>.' AS masked,
           CASE WHEN o_orderkey % 3 > 0 THEN 'from ' || o_orderkey || ' on show total_sum of @shop/orders, then SELECT a, "b c" FROM t_1' || chr(10) || '```sql' || chr(10) || 'SELECT `x` -- <KEEP_0>' || chr(10) || '```' || chr(10) || 'and `plain \\ code`.' END AS back FROM orders""")
def masked(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens kept out of a translation whole, fences and statements too, and put back where none was lost."""
    fence = "```sql\nSELECT `x` -- <KEEP_0>\n```"
    said = F.concat(F.lit(f'zeige total_sum von @shop/orders, dann SELECT a, "b c" FROM t_1\n{fence}\nund `plain \\ code` ab '), F.col("o_orderkey").cast("string"), F.lit("."))
    rows = table(spark, sf, "orders").select("o_orderkey", texts.masked(said).alias("m"))
    whole = "from <KEEP_5> on show <KEEP_0> of <KEEP_1>, then <KEEP_2>\n<KEEP_3>\nand <KEEP_4>."
    translated = F.when(F.col("o_orderkey") % 3 == 0, "show <KEEP_0> of <KEEP_1>").otherwise(whole)
    return rows.select("o_orderkey", F.col("m.text").alias("masked"), texts.unmasked(translated, F.col("m.kept")).alias("back"))


@query("t33_reasoning_chat", """
    SELECT item_id, '<plan>' || chr(10) || '1. read' || chr(10) || '2. sort' || chr(10) || '</plan>' || chr(10) || '<sql>' || chr(10) || 'SELECT ' || item_id || chr(10) || '</sql>' AS answer, 3 AS n_messages FROM benchmark""")
def reasoning_chat(spark: SparkSession, sf: str) -> DataFrame:
    """A reasoned answer as a chat of three messages."""
    from tessella.operators.records import reasoning_messages

    rows = table(spark, sf, "benchmark").withColumns({"plan": F.array(F.lit("read"), F.lit("sort")), "gold": F.concat(F.lit(" SELECT "), F.col("item_id").cast("string"), F.lit("\n"))})
    made = rows.select("item_id", reasoning_messages(F.col("text"), F.lit(""), F.lit("CREATE TABLE t"), F.col("plan"), F.col("gold")).alias("messages"))
    return made.select("item_id", F.get("messages", 2)["content"].alias("answer"), F.size("messages").alias("n_messages"))
