"""Training records and what is retrieved for questions; benchmark items stand for questions, the tables' definitions for schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import records, retrieval
from tessella.registry import query, table

_DDL = {
    "customer": "CREATE TABLE customer (c_custkey, c_name, of, and)", "events": "CREATE TABLE events (event_id, ts, the, on)", "nation": "CREATE TABLE nation (n_nationkey, n_name, in, the)",
    "orders": "CREATE TABLE orders (o_orderkey, o_custkey, o_orderdate, re, that, it)", "part": "CREATE TABLE part (p_partkey)", "region": "CREATE TABLE region (r_regionkey, er, at, is)",
}
_BLOCKS = "(VALUES " + ", ".join(f"({i}, '{n}', '{d}')" for i, (n, d) in enumerate(_DDL.items())) + ") b(place, name, block)"
_TERMS = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z0-9_][A-Za-z0-9_]+'), lambda x: lower(x)))"


def blocks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(_DDL.items())], "place int, name string, block string")


@query("t21_balanced_copies", """
    SELECT doc_id, CAST(unnest(range(1 + CAST(doc_id % 4 = 0 AS INT) + CAST(lang IN ('fr', 'de') AS INT))) AS INTEGER) AS copy FROM documents""")
def balanced(spark: SparkSession, sf: str) -> DataFrame:
    """Next-action examples as often as the balance wants them."""
    from tessella.operators.trajectories import repeated

    action = F.when(F.col("doc_id") % 4 == 0, "submit_solution").otherwise("execute_sql")
    drift = F.when(F.col("lang") == "fr", "add_column").when(F.col("lang") == "de", "compound").otherwise("rename_column")
    return repeated(table(spark, sf, "documents"), records.balanced_copies(action, drift)).select("doc_id", "copy")


@query("t22_environment_records", """
    SELECT p_partkey, 'tasks/' || CASE WHEN p_partkey % 3 = 0 THEN 'add_column+rename_table' ELSE 'rename_table' END AS data_source, 'SELECT ' || p_size || ' AS fixed' AS ground_truth, CAST(p_partkey AS VARCHAR) AS instance_id,
           p_size AS row_count, sha256(p_brand) AS value_hash, 'Which parts are ' || p_brand || '?' AS asked FROM part""")
def environments(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks as records of environments with their tools."""
    drift = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("rename_table"), F.lit("add_column"), F.lit("rename_table"))).otherwise(F.array(F.lit("rename_table")))
    size = F.col("p_size").cast("string")
    made = records.environment_record(
        F.col("p_partkey").cast("string"), F.col("p_brand"), drift, F.concat(F.lit("Which parts are "), "p_brand", F.lit("?")), F.concat(F.lit("SELECT "), size), F.concat(F.lit("SELECT "), size, F.lit(" AS fixed")),
        F.col("p_size"), F.sha2("p_brand", 256), ["get_schema_version", "inspect_schema_diff", "execute_sql", "submit_solution"],
    )
    rows = table(spark, sf, "part").select("p_partkey", made.alias("r"))
    tool = F.col("r.extra_info.execute_sql.result_fingerprint")
    return rows.select("p_partkey", "r.data_source", "r.ground_truth", "r.extra_info.instance_id", tool["row_count"].alias("row_count"), tool["value_hash"].alias("value_hash"), F.get("r.prompt", 0)["content"].alias("asked"))


@query("t22_tool_chats", """
    WITH s AS (SELECT l_orderkey, l_linenumber AS p, l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last, l_linenumber % 4 = 0 AS submits, CAST(l_suppkey AS VARCHAR) AS k FROM lineitem),
         m AS (SELECT l_orderkey, p, 0 AS q, 'assistant:{"name":"' || CASE WHEN submits THEN 'submit_solution' ELSE 'execute_sql' END || '","arguments":"' || k || '"}' AS said FROM s
               UNION ALL SELECT l_orderkey, p, 1, 'tool:seen ' || k FROM s WHERE NOT submits AND NOT last)
    SELECT l_orderkey, count(*) AS n, sha256(string_agg(said, chr(10) ORDER BY p, q, said)) AS chat FROM m GROUP BY 1""")
def tool_chats(spark: SparkSession, sf: str) -> DataFrame:
    """Steps as messages of an assistant and a tool."""
    steps = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("place"), F.when(F.col("l_linenumber") % 4 == 0, "submit_solution").otherwise("execute_sql").alias("action"),
        F.col("l_suppkey").cast("string").alias("arguments"), F.concat(F.lit("seen "), F.col("l_suppkey").cast("string")).alias("observation"),
    )
    made = records.tool_steps(steps, "l_orderkey")
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return made.select("l_orderkey", F.size("messages").cast("long").alias("n"), F.sha2(text, 256).alias("chat"))


@query("t23_contract_audit", """
    WITH s AS (SELECT l_orderkey, max(l_linenumber) AS n, max(l_linenumber) FILTER (l_linenumber % 4 = 0) AS submit, min(l_linenumber) AS first, count(*) AS rows FROM lineitem GROUP BY 1)
    SELECT l_orderkey, submit = n AS ends_with_submit, rows = n AND first = 1 AS gap_free, coalesce(submit, 0) > 0 AS submitted FROM s""")
def contract_audit(spark: SparkSession, sf: str) -> DataFrame:
    """What every trajectory has to keep to: it is gap-free, submits, and ends there."""
    n, submit = F.max("l_linenumber"), F.max(F.when(F.col("l_linenumber") % 4 == 0, F.col("l_linenumber")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        (submit == n).alias("ends_with_submit"), ((F.count("*") == n) & (F.min("l_linenumber") == 1)).alias("gap_free"), submit.isNotNull().alias("submitted")
    )


_ASKED = """SELECT item_id, item_id % 10 AS task, CASE item_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'What is the net revenue of a region?' WHEN 2 THEN 'which REGION' WHEN 3 THEN 'net of what' ELSE 'hello there' END AS question FROM benchmark"""
_AMBIGUOUS = "(VALUES ('net revenue', 0), ('region', 1), ('revenue', 0), ('net', 1)) a(term, priority)"


@query("t25_clarified", f"""
    WITH q AS ({_ASKED}), n AS (SELECT *, count(*) FILTER (trim(question) <> '') OVER (PARTITION BY task ORDER BY item_id) AS n FROM q),
         m AS (SELECT item_id, task, term, contains(lower(question), term) AS phrase, len(list_intersect({_TERMS.format("question")}, {_TERMS.format("term")})) AS words, priority FROM n CROSS JOIN {_AMBIGUOUS} WHERE trim(question) <> '' AND n <= 2),
         b AS (SELECT item_id, task, term, row_number() OVER (PARTITION BY item_id ORDER BY phrase DESC, words DESC, priority, term) AS k FROM m WHERE phrase OR words > 0),
         c AS (SELECT n.*, b.term FROM n LEFT JOIN b ON b.item_id = n.item_id AND k = 1)
    SELECT item_id, term, CASE WHEN trim(question) = '' THEN 'empty' WHEN n > 2 THEN 'over_budget' WHEN term IS NULL THEN 'unanswerable'
        WHEN row_number() OVER (PARTITION BY task, term ORDER BY item_id) = 1 THEN 'matched' ELSE 'repeated' END AS outcome FROM c""")
def clarified(spark: SparkSession, sf: str) -> DataFrame:
    """What a guarded user answers to questions about ambiguous terms."""
    said = """CASE item_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'What is the net revenue of a region?' WHEN 2 THEN 'which REGION' WHEN 3 THEN 'net of what' ELSE 'hello there' END AS question"""
    asked = table(spark, sf, "benchmark").selectExpr("item_id", "item_id % 10 AS task", said)
    terms = spark.range(10).select(F.col("id").alias("task"), F.explode(F.expr("array(('net revenue', 0), ('region', 1), ('revenue', 0), ('net', 1))")).alias("a")).select("task", F.col("a.col1").alias("term"), F.col("a.col2").alias("priority"))
    return records.clarified(asked, "item_id", "item_id", terms, 2)


@query("t26_schema_blocks", f"""
    WITH s AS (SELECT item_id, place, name, length(block) AS size, len(list_intersect({_TERMS.format("text")}, {_TERMS.format("block")})) AS k FROM benchmark CROSS JOIN {_BLOCKS}),
         p AS (SELECT *, max(k) OVER (PARTITION BY item_id) AS best FROM s)
    SELECT item_id, string_agg(name, ',' ORDER BY k DESC, place) AS blocks, sum(size) + 2 * (count(*) - 1) > 150 AS truncated FROM p WHERE k > 0 OR best = 0 GROUP BY 1""")
def schema_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a schema for each question, by shared terms: all of them, also where they don't fit."""
    return records.ranked_blocks(table(spark, sf, "benchmark"), "item_id", "text", blocks(spark), 150)


_RANKED = """
         p AS (SELECT *, max(k) OVER (PARTITION BY item_id) AS best FROM s),
         c AS (SELECT *, row_number() OVER w AS n, sum(size + 2) OVER w - 2 AS until FROM p WHERE k > 0 OR best = 0 WINDOW w AS (PARTITION BY item_id ORDER BY k DESC, place))
    SELECT item_id, string_agg(name, ',' ORDER BY n) FILTER (until - size < {0}) AS blocks, max(until) > {0} AS truncated FROM c GROUP BY 1"""


@query("t26_document_blocks", f"""
    WITH d AS (SELECT doc_id AS place, 'd' || doc_id AS name, left(text, 400) AS block FROM documents WHERE length(text) > 0),
         s AS (SELECT item_id, place, name, length(block) AS size, len(list_intersect({_TERMS.format("text")}, {_TERMS.format("block")})) AS k FROM benchmark CROSS JOIN d),{_RANKED.format(1500)}""")
def document_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same over a base that grows with the data: the beginnings of all documents."""
    base = table(spark, sf, "documents").where("length(text) > 0").select(F.col("doc_id").alias("place"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.substring("text", 1, 400).alias("block"))
    return retrieval.ranked_blocks(table(spark, sf, "benchmark"), "item_id", "text", base, 1500)


_BEST = """
         s AS (SELECT item_id, knowledge, contains(q, lower(knowledge)) OR contains(lower(knowledge), q) AS phrase, CAST(len(list_intersect(t, u)) AS INTEGER) AS overlap FROM q CROSS JOIN k)
    SELECT * FROM s WHERE phrase OR overlap > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY phrase DESC, overlap DESC, knowledge) <= {}"""
_ASKED = f"q AS (SELECT item_id, lower(trim(text)) AS q, {_TERMS.format('text')} AS t FROM benchmark)"


@query("t27_knowledge_top_k", f"""
    WITH k AS (SELECT knowledge, {_TERMS.format("knowledge || ' ' || block")} AS u FROM (SELECT name AS knowledge, block FROM {_BLOCKS} UNION ALL SELECT 'hea', 'x')), {_ASKED},{_BEST.format(2)}""")
def knowledge(spark: SparkSession, sf: str) -> DataFrame:
    """The two entries of a knowledge base that fit each question best."""
    base = blocks(spark).select(F.col("name").alias("knowledge"), F.col("block").alias("entry")).unionByName(spark.createDataFrame([("hea", "x")], "knowledge string, entry string"))
    return retrieval.best_entries(table(spark, sf, "benchmark"), "item_id", "text", base, 2)


@query("t27_document_knowledge", f"""
    WITH k AS (SELECT left(text, 20) || ' ' || doc_id AS knowledge, {_TERMS.format("left(text, 20) || ' ' || doc_id || ' ' || left(text, 400)")} AS u FROM documents WHERE text IS NOT NULL), {_ASKED},{_BEST.format(3)}""")
def document_knowledge(spark: SparkSession, sf: str) -> DataFrame:
    """The same over a base that grows with the data: an entry for each document."""
    name = F.concat(F.substring("text", 1, 20), F.lit(" "), F.col("doc_id").cast("string"))
    base = table(spark, sf, "documents").where("text IS NOT NULL").select(name.alias("knowledge"), F.substring("text", 1, 400).alias("entry"))
    return retrieval.best_entries(table(spark, sf, "benchmark"), "item_id", "text", base, 3)


# Packed greedily in a recursive query: one object after the other, by rank.
@query("t28_packed_context", f"""
    WITH RECURSIVE o AS (SELECT item_id, name, length(block) + 2 AS size, name = 'part' OR (name = 'nation' AND item_id % 2 = 0) AS needed, len(list_intersect({_TERMS.format("text")}, {_TERMS.format("name || ' ' || block")})) AS k FROM benchmark CROSS JOIN {_BLOCKS}),
         r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k DESC, size, name DESC) AS n FROM o WHERE NOT needed),
         g AS (SELECT item_id, CAST(0 AS BIGINT) AS n, CAST(sum(size) AS BIGINT) AS used, list(name) AS names FROM o WHERE needed GROUP BY 1
               UNION ALL SELECT g.item_id, g.n + 1, CASE WHEN used + size <= 200 THEN used + size ELSE used END, CASE WHEN used + size <= 200 THEN list_append(names, r.name) ELSE names END FROM g JOIN r ON r.item_id = g.item_id AND r.n = g.n + 1)
    SELECT item_id, array_to_string(list_sort(arg_max(names, n)), ',') AS chosen FROM g GROUP BY 1""")
def packed(spark: SparkSession, sf: str) -> DataFrame:
    """The definitions that go into a prompt of bounded size."""
    needed = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("part"), F.lit("nation"))).otherwise(F.array(F.lit("part")))
    rows = table(spark, sf, "benchmark").withColumn("needed", needed)
    packed = records.packed_context(rows, "item_id", "text", "needed", blocks(spark).select("name", F.col("block").alias("ddl")), 200)
    return packed.select("item_id", F.array_join("chosen", ",").alias("chosen"))
